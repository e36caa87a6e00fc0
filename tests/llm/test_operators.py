"""Each operator against brute force, on rows with nulls, empty and long texts, copies and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from auditlake.llm import (
    inner_products, line_dedup, main_text, mixing, near_duplicates, oracles, packing, passages, quality_classifier, quality_rules, token_orc,
)
from auditlake.llm.tokens import Encoder, public_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_duckdb(sql, rows, names, table="documents"):
    import pandas as pd

    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=names).convert_dtypes())
    con.execute(f"create table {table} as select * from given")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(df, names, rows):
    got = sorted(map(repr, (tuple(r[n] for n in sorted(names)) for r in df.collect())))
    order = [names.index(n) for n in sorted(names)]
    assert got == sorted(repr(tuple(r[k] for k in order)) for r in rows)


def test_quality_rules(docs, corpus, no_docs):
    known = [r for r in corpus if r[0] is not None and r[0] != 13]
    names, want = in_duckdb(oracles.op1(), [r[:4] for r in known], ["doc_id", "text", "lang", "source"])
    got = quality_rules.quality(docs.where("doc_id is not null and doc_id <> 13"))
    assert {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["kept"]) for r in got.collect()} == {
        r[names.index("doc_id")]: tuple(r[names.index(n)] for n in ("n_words", "n_repeat_words", "n_dup_lines", "kept")) for r in want
    }
    assert quality_rules.quality(docs).count() == len(corpus)
    assert quality_rules.quality(no_docs).count() == 0
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns and {4, 5, 6, 8, 14}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_repeated_windows(spark):
    text = " ".join(["a b c d e f g h"] * 3 + ["x y z"])
    rows = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    words = text.split()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 8)}
    assert quality_rules.features(rows).first()["n_repeat_words"] == len(covered)


def test_inner_products(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12) * (1 + i % 5)], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [float("nan")] * 12, 0), (302, [1.0, None] * 6, 0), (350, rows[7][1], 0), (400, rows[7][1], 0), (450, [0.0] * 12, 0), (500, [1.0, 2.0], 0), (None, rows[3][1], 0), (50, rows[50][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in inner_products.top_k(frame, block_rows=40).collect()}
    vecs = [(i, np.floor(256 * np.float32(v).astype(float)).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = {}
    for q, v in {i: v for i, v in vecs if i % 50 == 0}.items():
        ranked = sorted((-int(v @ c), i) for i, c in vecs if i != q and len(c) == len(v))[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(ranked)}
    assert got == want
    assert inner_products.top_k(frame.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies on this site to make it work well for you and for us</div>
<div class="ad">Buy this now it is very cheap and good and so on and on</div>
<article><h1>Big &amp; bold</h1><p>First  paragraph &lt;here&gt;<br>goes on.<p>Wh.<p><b>Unclosed</p><p>Last one with 5 &euro;.</article>
<aside>More stories to read about other things that happened</aside><form><label>Mail</label><input></form>
<section id="comments"><p>Great article, thank you so much for writing all of this down for us</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "Big & bold\nFirst paragraph <here> goes on.\nWh.\nUnclosed\nLast one with 5 €."
    cut = PAGE[: PAGE.index("Last one")]
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (None, "u", cut, "x"), (5, "u", PAGE, "x"), (5, "u", PAGE, "x"), (6, "u", "<p " * 2000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in main_text.extract(frame).collect()]
    first = "Big & bold\nFirst paragraph <here> goes on.\nWh.\nUnclosed"
    assert sorted(got, key=repr) == sorted([(1, want, len(want)), (2, "", 0), (3, "", 0), (None, first, len(first)), (5, want, len(want)), (5, want, len(want)), (6, "", 0)], key=repr)
    assert main_text.extract(frame.limit(0)).count() == 0


def test_classifier_learns(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 2
        text = " ".join(["the cat and the dog"] * 5) if good else " ".join(["BUY!! NOW###"] * 12)
        rows.append((i, f"{text} {i}", "en"))
        labels.append((i, good, 0))
    rows += [(400, None, "en"), (401, "", "en"), (None, "the cat", "en"), (5, rows[5][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    found = quality_classifier.classify(docs, spark.createDataFrame([*labels, (7, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    out = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
    assert len(out) > 40 and all(r["predicted"] == r["doc_id"] % 2 for r in out if r["doc_id"] < 400)
    none = quality_classifier.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first()
    assert none["score"] == 0.5


def test_line_dedup(spark, docs, corpus, no_docs):
    lines = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta gamma delta epsilon zeta eta theta iota lambda"]
    long = " ".join(f"w{i}" for i in range(40))
    extra = [(20, f"{long}\n{lines[0]}"), (21, f"{long} more\n{lines[1]}\nx"), (22, f"{lines[0]}\n{long}"), (23, "x"), (24, f"new {long}")]
    rows = [(r[0], r[1]) for r in corpus] + extra
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names, want = in_duckdb(oracles.op5(), rows, ["doc_id", "text"])
    same(line_dedup.matches(frame).drop("text_hash"), names, want)
    assert line_dedup.matches(no_docs).count() == 0
    clean = line_dedup.cleaned(docs)
    assert clean.columns == docs.columns and clean.count() == len(corpus)
    texts = {r["doc_id"]: r["text"] for r in clean.collect() if r["doc_id"] is not None}
    assert texts[0] and texts[1] == "" and texts[4] is None


def test_passages(docs, corpus, no_docs):
    found = passages.repeated(docs).collect()
    words = {}
    for i, t, *_ in corpus:
        if i is not None and t is not None:
            words.setdefault(i, WORD.findall(t.translate(LOWER)))
    first, need = {}, defaultdict(set)
    for i in sorted(words):
        grams = [tuple(words[i][k : k + 50]) for k in range(len(words[i]) - 49)]
        for k, g in enumerate(grams):
            if first.setdefault(g, i) != i:
                need[i] |= set(range(k, k + 50))
    spans = defaultdict(set)
    for r in found:
        assert r["source_id"] < r["doc_id"] and r["n_words"] == r["end"] - r["start"] >= 50
        spans[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert all(need[i] <= spans[i] for i in need) and {1, 2, 3, 12} <= set(spans)
    assert {10, 11, 13, 14}.isdisjoint(spans)
    assert passages.repeated(no_docs).count() == 0
    left = {r["doc_id"]: r["text"] for r in passages.trimmed(docs).collect()}
    assert left[1].strip() == "" and left[10] == dict((i, t) for i, t, *_ in corpus)[10]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_librarys_ids(name, corpus):
    with open(public_path(name), encoding="utf-8") as f:
        code = Encoder(f.read())
    odd = ["a  b", " a", "a ", "a\n\nb", "it's, don't. x's", "É é ÉÉ. ß", "a\tb c\r\nd", "<|endoftext|> x", "x y z w", "½ ² 12 3a", "日本 語。 x", "ét́ a", "ΑΣ Σ.", "..., !!", "a,b .c"]
    for text in odd + [r[1] or "" for r in corpus]:
        assert code.ids(text).tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids


def _encoded(corpus, name):
    with open(public_path(name), encoding="utf-8") as f:
        code = Encoder(f.read())
    return [(i, np.array([*code.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t, *_ in corpus]


def test_token_orc(spark, docs, corpus, no_docs, tmp_path):
    want = sorted(_encoded(corpus, "byte_bpe_50k.json"), key=lambda x: (x[0] is not None, x[0] or 0))
    starts = np.cumsum([0, *(len(x) for _, x in want)])
    expected = [(i, int(s), len(x), zlib.crc32(x.tobytes())) for (i, x), s in zip(want, starts, strict=False)]
    assert sorted(map(tuple, token_orc.round_trip(docs, public_path("byte_bpe_50k.json")).collect()), key=lambda r: r[1]) == expected
    assert token_orc.round_trip(no_docs, public_path("byte_bpe_50k.json")).count() == 0
    token_orc.write_ids(docs, f"file://{tmp_path}/ids", public_path("byte_bpe_50k.json"))
    assert token_orc.read_ids(spark, f"file://{tmp_path}/ids").where("doc_id = 12").count() == 1


def test_packing(docs, corpus, no_docs):
    ids = defaultdict(list)
    for i, x in _encoded(corpus, "word_bpe_49k.json"):
        ids[i].append(x)
    packed = packing.pack(docs, public_path("word_bpe_49k.json"), window=256)
    found = [r.asDict() for r in packing.digests(packed).collect()]
    for r in found:
        own = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in found) == sum(len(x) for v in ids.values() for x in v)
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist()
    used = [sum(n for _, n in by[s]) for s in sorted(by)]
    assert sorted(by) == list(range(len(by))) and max(used) <= 256 and all(u >= 252 for u in used[:-1])
    assert packing.digests(packing.pack(no_docs, public_path("word_bpe_49k.json"))).count() == 0


def test_best_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(60):
        stock = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 90))
        sums = {0}
        for n, c in stock.items():
            sums |= {s + n * k for s in sums for k in range(1, c + 1)}
        fill = packing.best_fill(stock, sorted(stock, reverse=True), room)
        assert sum(n * c for n, c in fill.items()) == max(s for s in sums if s <= room)
        assert all(c <= stock[n] for n, c in fill.items())


def brute_components(rows, percent=75):
    sets = {}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, sets


def test_near_duplicates(spark, docs, corpus, no_docs):
    roots, sets = brute_components(corpus)
    got = near_duplicates.classes(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == roots[r["doc_id"]] and r["kept"] == (roots[r["doc_id"]] == r["doc_id"])
            assert r["n_shingles"] == len(sets[r["doc_id"]][0])
    assert near_duplicates.classes(no_docs).count() == 0
    kept = near_duplicates.kept(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, *(i for i in roots if roots[i] == i)}


def test_large_branches_of_near_copies(spark):
    """Groups past every size limit: near copies of one text, and texts that share half of theirs."""
    from .conftest import prose

    base, shared = prose(50, 100).split(), prose(51, 60)
    rows = []
    for i in range(60):
        own = base.copy()
        own[(7 * i) % 100] = f"v{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, f"{shared} {prose(200 + i, 30)}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    roots, _ = brute_components(rows)
    small = near_duplicates.Join(small=4, depth=2, block_rows=16)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.classes(frame, small).collect()} == roots


def test_mixing(spark, docs, corpus, no_docs):
    known = [r[:4] for r in corpus if r[0] is not None]
    names, want = in_duckdb(oracles.op10(), known, ["doc_id", "text", "lang", "source"])
    same(mixing.schedule(docs.where("doc_id is not null")), names, want)
    rows = [(i, f"w{i} " * (1 + i % 7), "big" if i % 10 else None) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.schedule(frame, mixing.Mix(max_repeats=3.0))
    by = {r["source"]: (r["n"], r["d"]) for r in found.groupBy("source").agg({"n_tokens": "sum", "doc_id": "count"}).toDF("source", "n", "d").collect()}
    total = {s: sum(1 + i % 7 for i, _, x in rows if x == s) for s in ("big", None)}
    assert by["big"] == (total["big"], 1800) and abs(by[None][0] / total[None] - 3.0) < 0.02
    plan = {r["source"]: r for r in mixing.plan(frame, mixing.Mix(target_entropy=0.8, max_repeats=None, budget=4000)).collect()}
    shares = [r["weight"] for r in plan.values()]
    assert abs(sum(shares) - 1) < 1e-9 and abs(-sum(x * np.log2(x) for x in shares) - 0.8) < 1e-4
    assert mixing.schedule(no_docs).count() == 0 and mixing.apply(docs).columns[: len(docs.columns)] == docs.columns
