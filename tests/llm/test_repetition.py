import collections
import random
import re
import tracemalloc

import duckdb

from loomframe.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, n=5):
    text = text or ""
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    covered = {k for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), sum(len(words[k]) for k in covered)


def test_counts_against_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [None, "", " \n", "a b c d e f g h i j a b c d e", "x\n\nx\n", "a b c d e a b c d e a"]
    x = repetition.measure(texts)
    for i, t in enumerate(texts):
        assert tuple(int(x[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_5")) == brute(t)
        for n in (6, 8, 10):
            assert x[f"chars_{n}"][i] == brute(t, n)[5]


def test_pieces_and_confusing_sequences(monkeypatch, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()] + [None, "", "a\n\nb\n a \na"]
    whole = repetition.measure(texts)
    monkeypatch.setattr(repetition, "PIECE", 100)
    assert all((whole[k] == x).all() for k, x in repetition.measure(texts).items())
    # Sequences whose polynomials modulo 2^64 are equal for every odd base: as characters of a line and of a word.
    flip = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ y] for x in flip) for y in (0, 1))
    rest = " one two three four five six"
    for text in (f"{a}\n{b}\n{a}", f"{a}{rest}\n{b}{rest}", f"x {a} y z w\nx {b} y z w"):
        x = repetition.measure([text])
        assert tuple(int(x[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_5")) == brute(text)


def test_memory_of_long_texts():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1_500_000))
    tracemalloc.start()
    repetition.measure([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(text)


def test_verdicts(docs):
    prose = " ".join(f"word{i} of{i * 7 % 13} many{i * 5 % 11}" for i in range(60))
    line = "the same line of eight words once more\n"
    rows = [(1, prose), (2, "ha " * 40), (3, "too short"), (4, prose + "\n" + line * 40), (5, None)]
    got = {r.doc_id: r for r in repetition.coverage(docs(rows)).collect()}
    assert got[1].kept and not got[1].base_failed
    assert not got[2].kept and got[2].base_failed and got[3].base_failed and got[5].base_failed and not got[4].kept and got[4].dup_line_share > 0.5


def test_odd_rows(odd, clash):
    rows = repetition.coverage(odd).collect()
    assert len(rows) == 11 and rows[0][1:] == rows[1][1:]
    assert sorted(map(repr, repetition.coverage(clash).collect())) == sorted(map(repr, rows)) and repetition.coverage(odd.limit(0)).collect() == []


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = repetition.op7_repetition(spark, sf_dir)
    rel = con.sql(repetition.ORACLE).order("doc_id")
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == rel.fetchall()
