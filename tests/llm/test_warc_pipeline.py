import gzip
import hashlib
import os
import re
import tempfile

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import queries, warc
from folioscope.session import ship_package
from tests.llm import helpers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def pages():
    large, other = "<p>é large</p>" * 100, "<p>other</p>" * 200
    return [(1, "http://a", large), (2, "http://b", large), (3, None, large), (4, "http://d\r\nX: y", None), (5, "http://e", ""),
            (6, "http://f", "small"), (7, "http://g", "small"), (8, "http://h", other), (8, "http://h", other),
            (9, "http://i", other + "!"), (None, "http://j", other), (10, "http://k", "\r\n\r\nWARC/1.1\r\n" * 100)]


def expected(rows):
    last, count = {}, {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000:
            count[html] = count.get(html, 0) + 1
            if i is not None:
                last[html] = max(last.get(html, i), i)
    out, done = [], set()
    for i, _, html in rows:
        data = (html or "").encode()
        again = count.get(html, 0) > 1 and (i != last.get(html) or (i, html) in done)
        done.add((i, html))
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response",
                    last.get(html) if again else None))
    return sorted(out, key=repr)


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("roll", [1, 16 << 20])
def test_archives_read_back(spark, roll):
    folder = tempfile.mkdtemp() + "/archive"
    made = helpers.frame(spark, pages(), "page_id long, url string, html string")
    manifest = warc.write(made, folder, roll=roll)
    assert manifest.selectExpr("sum(records)").first()[0] == len(pages())
    assert helpers.rows_of(warc.read(spark, folder), *NAMES) == expected(pages())
    again = tempfile.mkdtemp() + "/archive"
    shas = ("file", "sha256")
    assert helpers.rows_of(warc.write(made, again, roll=roll), *shas) == helpers.rows_of(manifest, *shas)
    files = sorted(x for x in os.listdir(folder) if x.endswith(".gz"))
    assert files == sorted(r["file"] for r in manifest.collect())
    text = gzip.open(f"{folder}/{files[0]}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and re.search(rb"WARC-Payload-Digest: sha1:[A-Z2-7]{32}\r\n", text)


def test_stray_files_are_not_read_and_damage_is_found(spark):
    folder = tempfile.mkdtemp() + "/archive"
    warc.write(helpers.frame(spark, pages(), "page_id long, url string, html string"), folder, roll=1)
    with open(f"{folder}/_part-stray.warc.gz.7", "wb") as file:
        file.write(b"half a file")
    assert warc.read(spark, folder).count() == len(pages())
    name = sorted(x for x in os.listdir(folder) if x.startswith("part"))[0]
    whole = gzip.open(f"{folder}/{name}").read()
    with open(f"{folder}/{name}", "wb") as file:
        file.write(gzip.compress(whole[:-6] + b"#\r\n\r\n"))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, folder).count()


def test_empty_table(spark):
    folder = tempfile.mkdtemp() + "/archive"
    warc.write(helpers.frame(spark, [], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def documents(spark, rows):
    made = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return helpers.frame(spark, made, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_keep_clean_documents(spark, sf_dir):
    """Each stage on its own input: planted rows go, clean ones stay as they are."""
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = [(1000 + i, f"clean {i} " + " ".join(f"c{i}x{j}" for j in range(60))) for i in range(5)]
    odd = [(2000, None), (2001, ""), (None, "no id here " + helpers.long_text(30))]
    passage = helpers.BASE + "A passage of more than two hundred bytes that stands twice in two texts which differ otherwise."

    def ids(stage, rows):
        out = stages[stage](spark, documents(spark, rows), sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        return {r["doc_id"]: r["text"] for r in out.collect()}

    got = ids("benchmark_decontamination", clean + odd + [(1, f"before {item} after")])
    assert got == dict(clean + odd)
    got = ids("ngram_jaccard_join", [*clean, *odd, (1, clean[0][1]), (2, clean[0][1] + " more"), (1, clean[0][1])])
    assert got == dict([*clean[1:], (1, clean[0][1]), *odd[:1], odd[2]])
    got = ids("suffix_array_dedup", clean + odd + [(1, "one " + passage + " tail"), (2, "two " + passage + " end"),
                                                   (3, passage * 2)])
    assert {i: t for i, t in got.items() if i not in (1, 2)} == dict(clean + odd)
    assert got[1].split() == ["one", "tail"] and got[2].split() == ["two", "end"]
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, documents(spark, []), sf_dir).count() == 0, name


def test_run(spark):
    """Stage by stage against plain statements is tested above and with the operators; here the chain."""
    table = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{table}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{table}/labels.parquet").collect()}
    packed = corpus_pipeline.run(spark, table).toPandas()
    kept = set(packed["doc_id"])
    assert kept < set(rows) and len(kept) > 0.7 * len(rows)
    toxic = {i for i, x in labels.items() if x}
    assert len(kept & toxic) < 0.5 * len(toxic)
    filled = packed.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 2048
    assert (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()


def survivors(rows, digest):
    """(doc_id, text) that one of each group of near duplicates leaves, by comparing all pairs."""
    sets, order = [set(helpers.shingles(t)) for _, t in rows], [helpers.words(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            near = order[i] == order[j] or bool(a & b) and len(a & b) >= 0.8 * len(a | b)
            if near and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    best = {}
    for g, (i, text) in zip(group, rows, strict=True):
        best.setdefault(g, []).append((i is None, i or 0, digest[text], (i, text)))
    return sorted((min(own)[-1] for own in best.values()), key=repr)


def ids_that_name_nothing():
    """(doc_id, text): null ids, and ids that stand for different texts, with near and exact copies."""
    lone = [f"text {k} " + " ".join(f"t{k}x{j}" for j in range(60)) for k in range(14)]
    rows = [(None, t) for t in lone[:5]] + [(8, t) for t in lone[5:9]] + [(9, lone[9]), (7, lone[9] + " more")]
    rows += [(None, lone[0]), (8, lone[5]), (None, lone[10]), (30, lone[10] + " more"), (31, lone[11]), (None, lone[11])]
    return rows + [(8, lone[12] + " tail"), (8, lone[12]), (None, None), (8, ""), (None, lone[13] + " end"), (None, lone[13])]


def digests(spark, rows):
    made = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string")
    return {r["text"]: r["h"] for r in made.selectExpr("text", "xxhash64(text) AS h").collect()}


def test_groups_with_equal_least_ids_all_keep_one(spark, sf_dir):
    rows = ids_that_name_nothing()
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, documents(spark, rows), sf_dir)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert helpers.rows_of(kept, "doc_id", "text") == survivors(rows, digests(spark, rows))


def test_run_is_the_chain_of_plain_statements(spark, tmp_path):
    """run() on a table whose ids are null or repeated, against each stage's rule on the rows the one before kept."""
    item = " ".join(f"bench{j}" for j in range(20))
    passage = helpers.BASE.encode("ascii", "ignore").decode() + "and some more words until there are two hundred bytes of it."
    rows = ids_that_name_nothing() + [(100 + i, " ".join(f"mild{i}x{j}" for j in range(40))) for i in range(150)]
    rows += [(400 + i, f"zzvil snarg {' '.join(f'bad{i}x{j}' for j in range(6))} zzvil snarg") for i in range(90)]
    rows += [(None, "zzvil snarg twice zzvil snarg"), (None, f"words before {item} and after")]
    rows += [(8, f"quite another {item} text")]
    rows += [(i, f"{' '.join(f'own{n}x{j}' for j in range(50))} {passage} end{n}") for n, i in enumerate((None, None, 8, 8, 600))]
    made = documents(spark, rows)
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 400)) for i, _ in rows if i and 100 <= i < 500], "doc_id long, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = survivors([(i, t) for i, t in rows if "zzvil" not in (t or "")], digests(spark, rows))
    count = {}
    for _, text in left:
        for s in range(len(text or "") - 199):
            count[text[s:s + 200]] = count.get(text[s:s + 200], 0) + 1
    cut = []
    for i, text in left:
        gone = {s + k for s in range(len(text or "") - 199) if count[text[s:s + 200]] > 1 for k in range(200)}
        rest = text and "".join("\0" if s in gone else c for s, c in enumerate(text))
        rest = text and "\n".join(x for x in rest.split("\0") if x)  # what was apart stays apart
        if not gone or rest.strip():
            cut.append((i, rest))
    assert cut != left  # something was repeated

    def windows(text):
        w = helpers.words(text)
        return {tuple(w[i:i + 10]) for i in range(len(w) - 9)}

    clean = [(i, t) for i, t in cut if not windows(t) & windows(item)]
    assert len(clean) == len(cut) - 2
    bpe = Tokenizer.from_file(queries.vocabulary_path())
    want = sorted(((i, len(bpe.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in clean), key=repr)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    # each document has one piece that begins at 0
    assert helpers.rows_of(packed.where("start = 0"), "doc_id", "doc_tokens") == want
    assert packed.selectExpr("sum(length)").first()[0] == sum(n for _, n in want)
