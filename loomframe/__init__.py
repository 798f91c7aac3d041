"""Binary message frames as Spark tables: typed decode and encode, wire transforms, schema compilation and RPC traffic analysis."""
