"""Built-in layouts: sample schemas, the RPC protocol, and the schema compiler's own request.

All offsets are fixed values of the format and its protocol.
"""

from __future__ import annotations

from .layout import ANY, BOOL, CAP, DATA, FLOAT32, FLOAT64, INT8, INT16, INT32, INT64, TEXT, UINT8, UINT16, UINT32, UINT64, VOID, Field, Struct, Type, enum, group_of, list_of, struct_of

U64 = Type("uint64", bits=True)

# Samples.

PHONE = Struct("PhoneNumber", 1, 1, (Field("number", TEXT, 0, ""), Field("type", enum("mobile", "home", "work"), 0)))
EMPLOYMENT = Struct("employment", 1, 4, (Field("unemployed", VOID, tag=0), Field("employer", TEXT, 3, "", tag=1), Field("school", TEXT, 3, "", tag=2), Field("selfEmployed", VOID, tag=3)), union_at=4)
PERSON = Struct("Person", 1, 4, (Field("id", UINT32, 0), Field("name", TEXT, 0, ""), Field("email", TEXT, 1, ""), Field("phones", list_of(PHONE), 2, ()), Field("employment", group_of(EMPLOYMENT))))
ADDRESS_BOOK = Struct("AddressBook", 0, 1, (Field("people", list_of(PERSON), 0, ()),))
OPERATIONS = ("add", "subtract", "multiply", "divide")


def expression(depth: int = 4) -> Struct:
    """A calculator expression, unrolled to ``depth`` levels of calls; deeper parameters are left out."""
    call = (Field("op", enum(*OPERATIONS), 0),)
    if depth:
        call += (Field("params", list_of(expression(depth - 1)), 0, ()),)
    group = Struct("call", 2, 1, call)
    return Struct("Expression", 2, 1, (Field("literal", FLOAT64, 0, tag=0), Field("parameter", UINT32, 0, tag=1), Field("call", group_of(group), tag=2)), union_at=8)


def evaluate_request(depth: int = 4) -> Struct:
    return Struct("EvaluateRequest", 0, 1, (Field("expression", struct_of(expression(depth)), 0),))


EVALUATE_RESPONSE = Struct("EvaluateResponse", 1, 0, (Field("value", FLOAT64, 0),))
U64_PROBE = Struct("U64Probe", 2, 0, (Field("id", UINT64, 0), Field("signed", INT64, 8)))
ADDER_ID = 0xEA01E10CBC414411
ADD_PARAMS = Struct("add.Params", 2, 0, (Field("a", INT64, 0), Field("b", INT64, 8)))
ADD_RESULTS = Struct("add.Results", 1, 0, (Field("sum", INT64, 0),))

# RPC protocol.

VAT_ID = Struct("VatId", 1, 1, (Field("host", TEXT, 0, ""), Field("port", UINT16, 0)))
PROVISION_ID = Struct("ProvisionId", 1, 0, (Field("nonce", U64, 0),))
RECIPIENT_ID = Struct("RecipientId", 1, 1, (Field("vat", struct_of(VAT_ID), 0), Field("nonce", U64, 0)))
THIRD_PARTY_CAP_ID = Struct("ThirdPartyCapId", 1, 1, (Field("vat", struct_of(VAT_ID), 0), Field("nonce", U64, 0)))
JOIN_KEY_PART = Struct("JoinKeyPart", 1, 0, (Field("joinId", UINT32, 0), Field("partCount", UINT16, 4), Field("partNum", UINT16, 6)))
JOIN_RESULT = Struct("JoinResult", 1, 1, (Field("joinId", UINT32, 0), Field("succeeded", BOOL, 32), Field("cap", CAP, 0)))
OP = Struct("Op", 1, 0, (Field("noop", VOID, tag=0), Field("getPointerField", UINT16, 2, tag=1)), union_at=0)
PROMISED_ANSWER = Struct("PromisedAnswer", 1, 1, (Field("questionId", UINT32, 0), Field("transform", list_of(OP), 0, ())))
TARGET = Struct("MessageTarget", 1, 1, (Field("importedCap", UINT32, 0, tag=0), Field("promisedAnswer", struct_of(PROMISED_ANSWER), 0, tag=1)), union_at=4)
THIRD_PARTY_CAP = Struct("ThirdPartyCapDescriptor", 1, 1, (Field("id", struct_of(THIRD_PARTY_CAP_ID), 0), Field("vineId", UINT32, 0)))
CAP_DESCRIPTOR = Struct(
    "CapDescriptor", 1, 1,
    (
        Field("none", VOID, tag=0), Field("senderHosted", UINT32, 4, tag=1), Field("senderPromise", UINT32, 4, tag=2), Field("receiverHosted", UINT32, 4, tag=3),
        Field("receiverAnswer", struct_of(PROMISED_ANSWER), 0, tag=4), Field("thirdPartyHosted", struct_of(THIRD_PARTY_CAP), 0, tag=5), Field("attachedFd", UINT8, 2, 255),
    ), union_at=0,
)
PAYLOAD = Struct("Payload", 0, 2, (Field("content", ANY, 0), Field("capTable", list_of(CAP_DESCRIPTOR), 1, ())))
EXCEPTION = Struct("Exception", 1, 2, (Field("reason", TEXT, 0, ""), Field("obsoleteIsCallersFault", BOOL, 0), Field("obsoleteDurability", UINT16, 2), Field("type", UINT16, 4), Field("trace", TEXT, 1, "")))
SEND_RESULTS_TO = Struct("sendResultsTo", 3, 3, (Field("caller", VOID, tag=0), Field("yourself", VOID, tag=1), Field("thirdParty", ANY, 2, tag=2)), union_at=6)
CALL = Struct(
    "Call", 3, 3,
    (
        Field("questionId", UINT32, 0), Field("target", struct_of(TARGET), 0), Field("interfaceId", U64, 8), Field("methodId", UINT16, 4), Field("params", struct_of(PAYLOAD), 1),
        Field("sendResultsTo", group_of(SEND_RESULTS_TO)), Field("allowThirdPartyTailCall", BOOL, 128), Field("noPromisePipelining", BOOL, 129), Field("onlyPromisePipeline", BOOL, 130),
    ),
)
RETURN = Struct(
    "Return", 2, 1,
    (
        Field("answerId", UINT32, 0), Field("releaseParamCaps", BOOL, 32, True), Field("noFinishNeeded", BOOL, 33), Field("results", struct_of(PAYLOAD), 0, tag=0), Field("exception", struct_of(EXCEPTION), 0, tag=1),
        Field("canceled", VOID, tag=2), Field("resultsSentElsewhere", VOID, tag=3), Field("takeFromOtherQuestion", UINT32, 8, tag=4), Field("acceptFromThirdParty", ANY, 0, tag=5),
    ), union_at=6,
)
FINISH = Struct("Finish", 1, 0, (Field("questionId", UINT32, 0), Field("releaseResultCaps", BOOL, 32, True), Field("requireEarlyCancellationWorkaround", BOOL, 33, True)))
RESOLVE = Struct("Resolve", 1, 1, (Field("promiseId", UINT32, 0), Field("cap", struct_of(CAP_DESCRIPTOR), 0, tag=0), Field("exception", struct_of(EXCEPTION), 0, tag=1)), union_at=4)
RELEASE = Struct("Release", 1, 0, (Field("id", UINT32, 0), Field("referenceCount", UINT32, 4)))
BOOTSTRAP = Struct("Bootstrap", 1, 1, (Field("questionId", UINT32, 0), Field("deprecatedObjectId", ANY, 0)))
PROVIDE = Struct("Provide", 1, 2, (Field("questionId", UINT32, 0), Field("target", struct_of(TARGET), 0), Field("recipient", struct_of(RECIPIENT_ID), 1)))
ACCEPT = Struct("Accept", 1, 1, (Field("questionId", UINT32, 0), Field("provision", struct_of(PROVISION_ID), 0), Field("embargo", BOOL, 32)))
JOIN = Struct("Join", 1, 2, (Field("questionId", UINT32, 0), Field("target", struct_of(TARGET), 0), Field("keyPart", struct_of(JOIN_KEY_PART), 1)))
CONTEXT = Struct("context", 1, 1, (Field("senderLoopback", UINT32, 0, tag=0), Field("receiverLoopback", UINT32, 0, tag=1), Field("accept", VOID, tag=2), Field("provide", UINT32, 0, tag=3)), union_at=4)
DISEMBARGO = Struct("Disembargo", 1, 1, (Field("target", struct_of(TARGET), 0), Field("context", group_of(CONTEXT))))
#: Arms of a message, by discriminant.
MESSAGE_KINDS = ("unimplemented", "abort", "call", "return", "finish", "resolve", "release", "obsoleteSave", "bootstrap", "obsoleteDelete", "provide", "accept", "join", "disembargo")
_TYPED = {"abort": EXCEPTION, "call": CALL, "return": RETURN, "finish": FINISH, "resolve": RESOLVE, "release": RELEASE, "bootstrap": BOOTSTRAP, "provide": PROVIDE, "accept": ACCEPT, "join": JOIN, "disembargo": DISEMBARGO}
MESSAGE = Struct("Message", 1, 1, tuple(Field(k, struct_of(_TYPED[k]) if k in _TYPED else ANY, 0, None, tag=i) for i, k in enumerate(MESSAGE_KINDS)), union_at=0)

# The schema compiler's request.

#: Types by discriminant.
TYPE_KINDS = ("void", "bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "text", "data", "list", "enum", "struct", "interface", "anyPointer")
_VALUES = (
    Field("bool", BOOL, 16, tag=1), Field("int8", INT8, 2, tag=2), Field("int16", INT16, 2, tag=3), Field("int32", INT32, 4, tag=4), Field("int64", INT64, 8, tag=5),
    Field("uint8", UINT8, 2, tag=6), Field("uint16", UINT16, 2, tag=7), Field("uint32", UINT32, 4, tag=8), Field("uint64", UINT64, 8, tag=9),
    Field("float32", FLOAT32, 4, tag=10), Field("float64", FLOAT64, 8, tag=11), Field("text", TEXT, 0, "", tag=12), Field("data", DATA, 0, b"", tag=13), Field("enum", UINT16, 2, tag=15),
)
VALUE = Struct("Value", 2, 1, (Field("void", VOID, tag=0), *_VALUES, Field("list", VOID, tag=14), Field("struct", VOID, tag=16), Field("interface", VOID, tag=17), Field("anyPointer", VOID, tag=18)), union_at=0)


def schema_type(depth: int = 4) -> Struct:
    """A type; lists nest ``depth`` deep."""
    fields = (Field("typeId", U64, 8),) + tuple(Field(k, VOID, tag=i) for i, k in enumerate(TYPE_KINDS))
    if depth:
        fields += (Field("elementType", struct_of(schema_type(depth - 1)), 0),)
    return Struct("Type", 3, 1, fields, union_at=0)


SCHEMA_FIELD = Struct(
    "Field", 3, 4,
    (
        Field("name", TEXT, 0, ""), Field("codeOrder", UINT16, 0), Field("discriminantValue", UINT16, 2, 0xFFFF), Field("kind", enum("slot", "group"), 8), Field("offset", UINT32, 4),
        Field("typeId", U64, 16), Field("hadExplicitDefault", BOOL, 128), Field("type", struct_of(schema_type()), 2), Field("defaultValue", struct_of(VALUE), 3),
    ),
)
NESTED_NODE = Struct("NestedNode", 1, 1, (Field("name", TEXT, 0, ""), Field("id", U64, 0)))
#: Fields, enumerants and methods share a pointer; the widest, a field's, is read by kind.
ENUMERANT = Struct("Enumerant", 1, 2, (Field("name", TEXT, 0, ""), Field("codeOrder", UINT16, 0)))
METHOD = Struct("Method", 3, 5, (Field("name", TEXT, 0, ""), Field("codeOrder", UINT16, 0), Field("paramStructType", U64, 8), Field("resultStructType", U64, 16)))
NODE_KINDS = ("file", "struct", "enum", "interface", "const", "annotation")
_STRUCT_NODE = Struct(
    "struct", 6, 6,
    (
        Field("dataWordCount", UINT16, 14), Field("pointerCount", UINT16, 24), Field("isGroup", BOOL, 224), Field("discriminantCount", UINT16, 30), Field("discriminantOffset", UINT32, 32),
        Field("fields", list_of(SCHEMA_FIELD), 3, ()),
    ),
)
NODE = Struct(
    "Node", 6, 6,
    (
        Field("id", U64, 0), Field("displayName", TEXT, 0, ""), Field("displayNamePrefixLength", UINT32, 8), Field("scopeId", U64, 16), Field("nestedNodes", list_of(NESTED_NODE), 1, ()),
        Field("file", VOID, tag=0), Field("struct", group_of(_STRUCT_NODE), tag=1),
        Field("enum", group_of(Struct("enum", 6, 6, (Field("enumerants", list_of(ENUMERANT), 3, ()),))), tag=2),
        Field("interface", group_of(Struct("interface", 6, 6, (Field("methods", list_of(METHOD), 3, ()),))), tag=3),
        Field("const", VOID, tag=4), Field("annotation", VOID, tag=5),
    ), union_at=12,
)
REQUESTED_FILE = Struct("RequestedFile", 1, 2, (Field("id", U64, 0), Field("filename", TEXT, 0, "")))
REQUEST = Struct("CodeGeneratorRequest", 0, 4, (Field("nodes", list_of(NODE), 0, ()), Field("requestedFiles", list_of(REQUESTED_FILE), 1, ())))
