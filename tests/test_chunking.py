import random
import re

from pyspark.sql import functions as F

from folioscope.operators import chunking


def _sections(spark, rows):
    schema = ("document_id string, path string, root string, file_name string, extension string,"
              " modified_at long, text string")
    docs = spark.createDataFrame(
        [(f"r\u0000{n}", f"/r/{n}", "/r", n, e, 1, t) for n, e, t in rows], schema)
    return chunking.text_sections(docs)


def _holds(spark, rows):
    """What must be true of any cut: whole lines in order, nothing lost, sizes within the rules."""
    got = {}
    for r in chunking.chunk_sections(_sections(spark, rows)).orderBy("path", "cut_no").collect():
        got.setdefault(r.file_name, []).append(r)
    for name, ext, text in rows:
        lines = [line.rstrip() for line in text.split("\n")]
        own, prose = got.get(name, []), ext == "md"
        cost = [_cost(line) for line in lines]
        covered = set()
        for r in own:
            assert r.content == "\n".join(lines[r.start_line - 1:r.end_line]).strip(), name
            assert lines[r.start_line - 1].strip() and lines[r.end_line - 1].strip() and len(r.content) >= 12
            covered.update(range(r.start_line, r.end_line + 1))
            # all but the last line leave room; the first may be one long line carried over
            assert sum(cost[r.start_line:r.end_line - 1]) < (320 if prose else 420), name
        for a, b in zip(own, own[1:]):
            # one long line may be carried over and stand alone again
            assert a.start_line <= b.start_line and a.end_line <= b.end_line
            shared = cost[b.start_line:a.end_line]
            assert sum(shared) < (40 if prose else 64), name
        lost = [i for i, line in enumerate(lines, 1) if line.strip() and i not in covered]
        assert all(len(lines[i - 1].strip()) < 12 for i in lost), name
        ids = [r.chunk_id for r in own]
        assert len(set(ids)) == len({(r.start_line, r.end_line) for r in own}) and all(len(i) == 40 for i in ids)
        for r in own:
            where = r.source_location.rpartition("L")[2]
            assert where == (f"{r.start_line}-{r.end_line}" if r.end_line > r.start_line else f"{r.start_line}")


def _cost(line):
    wide = len(re.findall("[\u4e00-\u9fff]", line))
    return max(1, wide - (wide - len(line)) // 4)


def _random_text(rng, code):
    lines = []
    for _ in range(rng.randint(1, 260)):
        kind = rng.random()
        if kind < 0.12:
            lines.append("")
        elif kind < 0.18:
            lines.append("  ")
        elif kind < 0.22:
            lines.append("连接数据库" * rng.randint(1, 30))
        elif kind < 0.24:
            lines.append("w" * rng.randint(1000, 2500))
        elif code and kind < 0.34:
            lines.append(rng.choice([
                "def load_rows(path):", "    public static void runAll(int a) {",
                "const onSave = (e) => {", "class Parser:", "if (ready) {", "  return (x)",
                "@Override", "// note", "# note", "async def go():"]))
        else:
            lines.append("x" * rng.randint(1, 160) + " " * rng.randint(0, 2))
    return "\n".join(lines)


def test_random_documents_are_cut_by_the_rules(spark):
    rng = random.Random(7)
    rows = [(f"d{i}.{e}", e, _random_text(rng, e != "md"))
            for i in range(40) for e in ("md", "py", "java")]
    _holds(spark, rows)


def test_oversized_unit_and_small_units_give_two_chunks(spark):
    text = "\n".join(["长" * 400] + ["第%02d段补充内容说明" % i for i in range(21)])
    rows = chunking.chunk_sections(_sections(spark, [("a.md", "md", text)])).count()
    assert rows == 2


def test_code_symbols(spark):
    text = ("import os\nimport sys\n\n# Loads all rows of a table.\ndef load_rows(path):\n"
            "    path + 1\n\n@cached\ndef other_name(x):\n    return x + 12345\n")
    got = {r.source_location for r in chunking.chunk_sections(
        _sections(spark, [("a.py", "py", text)])).collect()}
    assert got == {"符号：文件头 · L1-2", "符号：load_rows · L4-6", "符号：other_name · L8-10"}


def test_token_estimate(spark):
    from folioscope.functions import text as tx
    row = spark.createDataFrame([("", "连接db", "abcde")], "a string, b string, c string").select(
        tx.chunk_tokens(F.col("a")), tx.prompt_tokens(F.col("a")), tx.chunk_tokens(F.col("b")),
        tx.chunk_tokens(F.col("c")), tx.prompt_tokens(F.col("b"))).first()
    assert list(row) == [1, 0, 3, 2, 3]
