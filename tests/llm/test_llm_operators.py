"""Operators on small fixtures: odd rows, empty tables, clashing columns, brute-force comparisons."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netsieve.llm import (cross_polytope, jaccard, language, licenses, mixing, pieces, quality_nbsvm, quality_rules, queries,
                          suffix_dedup, unit_dedup)

PROSE = " ".join(f"word{i} and" for i in range(60))
LINE = "this line of seven words comes back"
ROWS = [(1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE.replace("word7 ", "other "), "en", "b"), (4, None, None, None),
        (5, "", "fr", "a"), (6, f"un deux {LINE}\n{LINE}\n{LINE}\nfin", "fr", "a"), (7, f"{LINE}\nété", None, "a"),
        (8, "x" * 30000, "en", "a"), (8, "x" * 30000, "en", "a"), (9, "Released under the MIT License.", "en", "a"),
        (None, PROSE, "en", "a")]
EXTRA = ["ids", "kept", "n_links", "label", "key", "id", "score", "weight", "hash"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in EXTRA})


def mixed(df):
    dims = {"source": "source", "lang": "lang", "topic": mixing.length_topic(F.col("n_tokens"))}
    return mixing.mix(df, dims)


def nbsvm(df):
    model = quality_nbsvm.learn(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    return quality_nbsvm.score(df, model)


OPERATORS = {
    "encode": lambda d: pieces.encode(d, queries.piece_model_path()), "jaccard": jaccard.jaccard_join,
    "substrings": suffix_dedup.dedup_substrings, "language": lambda d: language.identify(d, *language.learn(d)),
    "units": unit_dedup.dedup_units, "paragraphs": lambda d: unit_dedup.dedup_units(d, unit="paragraph"), "mix": mixed,
    "licenses": licenses.scan, "nbsvm": nbsvm, "rules": quality_rules.quality_rules,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row_and_empty_tables(docs, name):
    got = OPERATORS[name](docs)
    ids = sorted((r[0] for r in got.collect()), key=lambda x: (x is None, x))
    assert ids == sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))
    assert OPERATORS[name](docs.where("false")).count() == 0


def test_encoding_is_the_librarys():
    m = pieces.model(queries.piece_model_path())
    rng = np.random.default_rng(3)
    alphabet = list(" ▁abtheinor.\n\t<s>0xA1éñßЖ漢😀ﬁ\x00,|*")
    texts = ["", " ", "  a  b", "a" * 3000, " " * 900, "=-" * 400, "<s></s><0x0A>", PROSE]
    texts += ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(1, 60, 1500)]
    for t in texts:
        ids = m.encode(t).tolist()
        assert ids == m.library.encode(t)
        assert m.decode(ids) == m.library.decode(ids)


def brute_substrings(rows):
    first = {}
    for d, t in sorted((d, (t or "").encode()) for d, t in rows):
        for i in range(len(t) - 49):
            first.setdefault(t[i:i + 50], d)
    out = {}
    for d, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i:i + 50]] < d:
                gone[i:i + 50] = True
        runs = int(np.diff(np.concatenate([[0], gone, [0]])).clip(0).sum())
        out[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdefg "), 400))
    rows = [(0, passage), (1, "zz" + passage[100:220] + "yy"), (2, passage[:49]), (3, passage[10:60] + "é" * 60), (4, "é" * 200),
            (5, "ab" * 300), (6, "ab" * 100 + passage), (7, None), (8, passage + passage), (9, "q" * 49 + passage[351:])]
    # A passage in many contexts, and more suffixes of one repeated pair of bytes than a run holds.
    rows += [(10 + k, "".join(rng.choice(list("hijk"), 70)) + passage[200:290] + "".join(rng.choice(list("hijk"), 70))) for k in range(30)]
    rows += [(50, "ab" * 1500 + "c" * 60), (51, "ab" * 1400 + "c" * 70), (52, "".join(rng.choice(list("hijk "), 30_000)) + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # Buckets sorted whole; and every bucket dealt on by its 50-byte strings.
    for bucket in (suffix_dedup.BUCKET, 0):
        got = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["starts"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
               for r in suffix_dedup.dedup_substrings(df, bucket=bucket).collect()}
        assert got == brute_substrings(rows)


def test_suffix_order_is_byte_order():
    rng = np.random.default_rng(4)
    raw = bytes(rng.choice([0, 97, 98, 255], 3000).astype(np.uint8)) + b"ab" * 100 + b"ab" * 100
    start = rng.permutation(len(raw) - 49)
    order, same = suffix_dedup.suffix_order(np.frombuffer(raw, np.uint8), start)
    heads = [raw[i:i + 50] for i in start[order]]
    assert heads == sorted(heads) and same.tolist() == [False] + [a == b for a, b in zip(heads, heads[1:])]


def test_suffixes_sorted_bucket_by_bucket(monkeypatch):
    """Buckets cut over batches and sorted a few at a time give what all of them together give."""
    rng = np.random.default_rng(5)
    rows = [(k, r, int(rng.integers(9)), bytes(rng.choice([2 * k, 2 * k + 1], 52 + r).astype(np.uint8)) if r % 3 else bytes([2 * k]) * (50 + r))
            for k in range(20) for r in range(12)]
    table = pa.table({n: list(c) for n, c in zip(["key", "run", "first_id", "bytes"], zip(*rows))})
    whole = suffix_dedup._judge(table).to_pylist()
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 100)
    parts = [r for b in suffix_dedup._sort_suffixes(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert len(whole) > 20 and parts == whole


def test_large_buckets_are_dealt_on_in_runs(spark):
    """A bucket above the bound goes on in runs, not as a row for each suffix; results are those of brute force."""
    rng = np.random.default_rng(8)
    hot = "".join(rng.choice(list("abcdefg "), 30))
    text = lambda n: "".join(rng.choice(list("hijk"), n))
    near = [text(30) + hot + text(30) for _ in range(4)]
    rows = [(k, text(40) + near[k % 4] + text(40) if k % 3 else text(80) + hot + text(80)) for k in range(120)]
    rows += [(200, "ab" * 400), (201, "ab" * 300 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bucket in (1, 40, 400):
        got = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["starts"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
               for r in suffix_dedup.dedup_substrings(df, bucket=bucket).collect()}
        assert got == brute_substrings(rows)
    runs = [bytes(rng.choice([0, 97, 98, 255], 50 + int(n)).astype(np.uint8)) for n in rng.integers(0, 60, 300)]
    entries = pa.RecordBatch.from_pydict({"key": [3] * 300, "run": list(range(300)), "first_id": list(range(300)), "bytes": runs})
    finer = pa.Table.from_batches(suffix_dedup._finer(iter([entries])))
    # Every suffix in one shorter run, with the bytes of its entry.
    assert sorted((r["run"], r["place"] + i, r["bytes"][i:i + 50]) for r in finer.to_pylist() for i in range(len(r["bytes"]) - 49)) == sorted(
        (k, i, b[i:i + 50]) for k, b in enumerate(runs) for i in range(len(b) - 49))
    assert finer.num_rows < sum(len(b) - 49 for b in runs) / 3


def test_places_of_common_keys(monkeypatch):
    """Keys with several texts keep all their places, however the lists of a share are cut and held."""
    rng = np.random.default_rng(9)
    key = np.concatenate([rng.integers(-50, 50, 400), np.full(300, 7)])
    row = np.concatenate([rng.integers(0, 400, 400), np.arange(300)])
    key[:30], row[:30] = 1000 + np.arange(30) // 3, np.arange(30) // 3  # several places in one text
    places = list(zip(key.tolist(), row.tolist(), range(700), range(50, 750)))
    texts: dict[int, set] = {}
    for k, r, *_ in places:
        texts.setdefault(k, set()).add(r)
    want = sorted(p for p in places if len(texts[p[0]]) > 1)
    packed = []
    for share in range(3):
        mine = [p for p in places if p[0] % 3 == share]
        for at in range(0, len(mine), 11):
            packed.append((share, *([p[c] for p in mine[at:at + 11]] for c in range(4))))
    schema = pa.schema({"share": pa.int32(), "key": pa.list_(pa.int64()), "row": pa.list_(pa.int64()),
                        "start": pa.list_(pa.int32()), "stop": pa.list_(pa.int32())})
    table = pa.table({n: [p[i] for p in packed] for i, n in enumerate(schema.names)}, schema=schema)
    for held in (1 << 20, 40, 1):
        monkeypatch.setattr(suffix_dedup, "HELD", held)
        got = [tuple(r.values()) for b in suffix_dedup._common(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()]
        assert sorted(got) == want


def test_quality_rules_leave_little_on_disk(spark):
    """When the texts are dealt out at the end, no band hashes or line lists are left in the shared folder."""
    rng = np.random.default_rng(10)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(500)]
    rows = [(k, "\n".join(" ".join(rng.choice(words, 4)) for _ in range(20)), "host") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: {p: os.path.getsize(p) for d, _, names in os.walk(folder) for n in names if os.path.isfile(p := os.path.join(d, n))}
    before = held()
    got = quality_rules.quality_rules(df)
    left = sum(size for p, size in held().items() if p not in before)
    assert left < 200 * len(rows), left
    assert got.count() == len(rows)


def test_jaccard_links_and_odd_rows(docs):
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(docs).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1]
    assert [got[i]["n_links"] for i in (1, 2, 3)] == [2, 2, 2]
    assert got[2]["class_id"] == 1 and got[3]["class_id"] == 3 and not got[2]["kept"]
    assert got[4]["n_links"] == 0 and got[4]["kept"] and got[None]["component_id"] is None and got[None]["kept"]


def test_jaccard_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[:k] + ["edit%d" % k] + words[k + 1:])) for k in range(0, 60)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {k: {tuple(t.split()[i:i + 5]) for i in range(196)} for k, t in rows}
    for r in got:
        want = sum(len(sets[r["doc_id"]] & s) / len(sets[r["doc_id"]] | s) >= 0.8 for k, s in sets.items() if k != r["doc_id"])
        assert r["n_links"] == want and r["component_id"] == 0


def test_units_keep_the_earliest_and_offsets(docs):
    rows = unit_dedup.dedup_units(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    text = ROWS[5][1]
    assert [text[a:b] for a, b in zip(got[6]["starts"], got[6]["ends"])] == [f"{LINE}\n"]
    assert got[7]["kept_text"] == "été" and got[4]["kept_text"] is None and got[5]["kept_text"] == ""
    assert got[None]["kept_text"] == "" and got[2]["kept_text"] == ""  # a null id comes last
    assert [r["kept_text"] for r in rows if r["doc_id"] == 8] == ["x" * 30000] * 2  # equal rows are one document


def brute_units(rows, run_words):
    """Texts without later lines and without runs of later clauses, by plain dictionaries."""
    import re

    lines, clauses, out = {}, {}, {}
    for d, text in sorted(rows):
        gone = [False] * len(text)
        at = 0
        for line in text.split("\n"):
            norm = " ".join(line.split())
            if norm and lines.setdefault(norm, (d, at)) != (d, at):
                gone[at: at + len(line) + 1] = [True] * len(text[at: at + len(line) + 1])
            at += len(line) + 1
        pieces = [(m.start(), m.end(), " ".join(m.group().split()))
                  for m in re.finditer(r"(?:[^\n]*?[.!?,;:][ \t]+)|[^\n]+", text)]
        run = []
        for a, b, norm in [p for p in pieces if p[2]] + [(0, 0, None)]:
            if norm is not None and clauses.setdefault(norm, (d, a)) != (d, a):
                run.append((a, b, norm))
                continue
            if sum(len(n.split()) for _, _, n in run) >= run_words:
                for x, y, _ in run:
                    gone[x:y] = [True] * (y - x)
            run = []
        out[d] = "".join(c for c, g in zip(text, gone) if not g)
    return out


@pytest.mark.parametrize("run_words", [1, 6, 20])
def test_passages_inside_lines_equal_brute_force(spark, run_words):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)] + ["日本語", "été"]

    def prose(n):
        return "".join(f"{w}{rng.choice(['', '', '', '', ',', '.', '; ', '!\t'])} " + rng.choice(["", "", "", "", "", "", "\n"])
                       for w in rng.choice(words, n))

    passage = "One passage of many words, that begins inside a line; and ends inside one: " + prose(55)
    rows = [(k, prose(40) + (passage if k % 3 == 0 else "") + prose(30)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in unit_dedup.dedup_units(df, run_words=run_words).collect()}
    assert {k: r["kept_text"] for k, r in got.items()} == brute_units(rows, run_words)
    for k, text in rows:
        spans = list(zip(got[k]["starts"], got[k]["ends"]))
        assert "".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)])) == got[k]["kept_text"]
    if run_words == 20:
        assert all(sum(b - a for a, b in zip(r["starts"], r["ends"])) > 0.7 * len(passage) for k, r in got.items() if k % 3 == 0 and k)


def test_units_of_any_length_and_without_spaces(spark):
    passage = "這是一段沒有空格的很長的文字" * 4
    rows = [(1, f"{passage}\n}}\n\nhome"), (2, f"new\n{passage}\n\n}}\nhome ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kept_text"] for r in unit_dedup.dedup_units(df).collect()} == {1: rows[0][1], 2: "new\n\n"}
    assert {r["doc_id"]: r["kept_text"] for r in unit_dedup.dedup_units(df, min_chars=5).collect()} == {
        1: rows[0][1], 2: "new\n\n}\nhome "}


def test_long_notices_are_counted(spark):
    notice = " ".join(f"notice{k}" for k in range(30))
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(60)) + f"\n{notice}\nend {i}", "h") for i in range(40)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r["n_removed_words"] for r in got) == 1200 and all(r["kept"] for r in got)
    for r in got:
        text = rows[r["doc_id"]][1]
        assert r["kept_text"] == text.replace(f"{notice}\n", "")
        assert [text[a:b] for a, b in zip(r["starts"], r["ends"])] == [notice]


def test_quality_rules_reject_depleted_documents(spark):
    menu = "home about contact news imprint"
    rows = [(i, f"{menu}\n{menu}\n" * 6 + " ".join(f"t{i}x{k}" for k in range(5)), "h") for i in range(30)]
    rows += [(100, " ".join(f"u{k}" for k in range(80)) + "\n" + menu, "h"), (101, None, "h")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i]["kept"] for i in range(30)) and got[100]["kept"] and got[100]["n_removed_words"] == 5
    assert got[101]["base_failed"] and got[0]["n_dup_lines"] == 11


def test_quality_rules_remove_long_boilerplate_and_spare_near_copies(spark):
    notice = "é " + " ".join(f"cookie{k}" for k in range(30))
    rows = [(i, " ".join(f"p{i}x{k}" for k in range(60)) + f"\n{notice}\nend {i}", "h") for i in range(12)]
    story = [" ".join(f"s{n}w{k}" for k in range(25)) for n in range(8)]
    rows += [(100 + i, "\n".join(story) + f"\nedit{i}", "h") for i in range(12)] + [(None, rows[0][1], "h"), (200, None, "h")]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for r in got:
        text = dict((k, t) for k, t, _ in rows)[r["doc_id"]]
        gone = r["doc_id"] is None or r["doc_id"] < 100
        assert r["kept"] == (r["doc_id"] != 200)
        assert r["kept_text"] == (text.replace(notice + "\n", "") if gone else text)
        assert r["n_removed_words"] == 31 * gone and [text[a:b] for a, b in zip(r["starts"], r["ends"])] == [notice] * gone


def test_pipeline_quality_writes_the_cleaned_text(spark):
    import corpus_pipeline
    menu = "home about contact"
    rows = [(i, " ".join(f"p{i}x{k}" for k in range(60)) + f"\n{menu}", "en", "h", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality(spark, docs, "").collect()
    assert len(got) == 12 and all(menu not in r["text"] and r["n_chars"] == len(r["text"]) for r in got)


def test_pipeline_verdicts_follow_the_row(spark):
    import corpus_pipeline
    text = [" ".join(f"d{n}x{k}" for k in range(60)) for n in range(4)]
    rows = [(None, "junk"), (None, text[0]), (None, text[0]), (None, text[1]), (7, text[1]), (7, text[2]), (7, "junk"),
            (8, text[3]), (9, text[3] + " more"), (7, text[2]), (None, text[3])]
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.quality(spark, docs, "")
    assert good.where("text = 'junk'").count() == 0 and good.count() == 9
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, good, "").collect()]
    assert sorted(got, key=repr) == sorted([(None, text[0]), (7, text[1]), (7, text[2]), (8, text[3])], key=repr)
    rows = [(None, "a line\nnull one"), (None, "a line\nnull two\nnull one"), (3, "shared\na line"), (3, "shared\nb line")]
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in rows], docs.schema)
    got = corpus_pipeline.repeated_units(spark, docs, "").collect()
    lines = [x for r in got for x in r["text"].split("\n") if x]
    assert sorted(lines) == ["a line", "b line", "null one", "null two", "shared"] and len(got) == 4
    assert all("a line" not in r["text"] for r in got if r["doc_id"] is None)


def test_licenses_prefilter_loses_nothing(docs, spark):
    grams = {n: set(licenses.bigrams(t)) for n, t in licenses.TEMPLATES.items()}
    words = licenses.key_words([sorted(g) for g in grams.values()], licenses.DICE)
    for g in grams.values():
        free = [x for x in g if not any(w in part for w in words for part in x.split())]
        assert len(free) < licenses.DICE * len(g) / (2 - licenses.DICE)
    rows = [(k, "Intro line.\n" + t.upper() + "\nmore") for k, t in enumerate(licenses.TEMPLATES.values())] + [(99, "all about rights")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(licenses.TEMPLATES)), 99: None}


def test_mixing_meets_its_marginals(spark):
    rows = [(i, "w " * (10 + i % 7), "ab"[i % 3 == 0], ["x", "y", "z"][i % 5 % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cells = df.groupBy("source", "lang", F.lit("t").alias("topic")).agg(F.sum(mixing.n_tokens("text")).alias("tokens"))
    got = mixing.fit_cells(cells, {"source": 0.0, "lang": 1.0, "topic": 1.0}, 12).toPandas()
    mass = got["tokens"] * got["weight"]
    assert np.allclose(mass.groupby(got["source"]).sum(), mass.sum() / 2, rtol=1e-6)
    out = mixed(df).toPandas()
    expected = (out["prob"] * out["n_tokens"]).sum() / out["n_tokens"].sum()
    assert abs(expected - mixing.SAMPLE_SHARE) < 1e-9 and ((out["prob"] >= 0) & (out["prob"] <= 1)).all()


def test_language_mixture_and_held_out_accuracy(spark):
    from netsieve.session import table
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = queries.QUERIES["op4_language_mixture"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and held["score"].between(0, 1).all()
    langs, logp = language.learn(docs)
    two = docs.where("lang in ('en', 'fr') and length(text) > 1000").groupBy().agg(
        F.concat_ws(" ", F.substring(F.max(F.when(F.col("lang") == "en", F.col("text"))), 1, 900),
                    F.substring(F.max(F.when(F.col("lang") == "fr", F.col("text"))), 1, 600)).alias("text"), F.lit(1).alias("doc_id"))
    got = language.identify(two, langs, logp).collect()[0]
    assert got["n_langs"] == 2 and 0.4 < got["score"] < 0.8


def test_language_without_letters(docs):
    langs, logp = language.learn(docs)
    odd = docs.select("doc_id", F.when(F.col("doc_id") < 3, "12 . ?").alias("text"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(odd, langs, logp).collect()} == {("und", 0.0)}


def test_quality_held_out(spark):
    from netsieve.session import table
    out = queries.QUERIES["op8_quality_nbsvm"](spark, "/root/testdata/sf0.1").join(
        table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95


def test_cross_polytope_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(300, 16))
    b = a + 0.05 * rng.normal(size=a.shape)
    rows = [(i, v.tolist(), i % 300 % 3) for i, v in enumerate(np.concatenate([a, b]))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [1.0] * 16, None),
             (905, [2.0] * 16, 1), (906, [2.0] * 16, 1), (907, [4.0] * 16, 1), (None, [2.0] * 16, 1), (908, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("class_id", F.lit(1))
    got = {r["vec_id"]: r for r in cross_polytope.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows[:600]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:600]])
    want = ((x @ x.T >= 0.93) & (lab[:, None] == lab)).sum(1) - 1
    found = sum(got[i]["n_links"] for i in range(600))
    assert 0.98 * want.sum() <= found <= want.sum()
    assert [got[i]["n_links"] for i in (900, 901, 902, 903, 904, 908)] == [0] * 6
    assert [got[i]["component_id"] for i in (905, 906, 907)] == [905] * 3 and got[905]["n_links"] == 2
    assert cross_polytope.near_vectors(df.where("false")).count() == 0
