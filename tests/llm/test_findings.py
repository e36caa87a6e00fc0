"""Cases that a reviewer found in the language-model operators."""

import random
import re

import numpy as np
import pyarrow as pa

from auditlake.llm import line_dedup, oracles, passages, shingles
from auditlake.llm.shingles import word_hashes

from .conftest import prose
from .test_operators import in_duckdb, same


def test_passage_whose_seeds_all_come_first_elsewhere(spark):
    """Earlier documents hold every seed of a passage, but not its ends; one of them holds the whole passage."""
    p, rows = passages.Passages(), []
    for case in range(6):
        r = random.Random(case)
        some = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]  # noqa: E731, B023
        common = some(p.min_words)
        one, two = (some(40) + common + some(40) for _ in range(2))
        at = [set(passages.seeds(word_hashes(" ".join(t)), p.k, p.w)[1].tolist()) for t in (one, two)]
        both = sorted(x for x in at[0] & at[1] if 40 <= x <= 40 + p.min_words - p.k)
        inner = one[both[0] : both[-1] + p.k]
        rows += [(10 * case, " ".join(some(30) + inner + some(30))), (10 * case + 1, " ".join(one)), (10 * case + 2, " ".join(two))]
    found = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    got = {r["doc_id"]: (r["start"], r["end"], r["source_id"]) for r in found}
    assert got == {10 * case + 2: (40, 90, 10 * case + 1) for case in range(6)}


def test_windows_that_passages_hold_are_not_looked_up(spark, monkeypatch):
    """Edited copies and shared lines are found by their seeds; only windows past their ends are looked up."""
    p, looked_up = passages.Passages(), []
    write = passages.written

    def counted(df, name):
        out = write(df, name)
        if name == "windows":
            looked_up.append(out.count())
        return out

    r = random.Random(5)
    some = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
    base, passage = some(600), some(90)
    edited = base.copy()
    edited[300] = "new"
    texts = [base, edited, some(80) + passage + some(80), some(60) + passage + some(70)]
    monkeypatch.setattr(passages, "written", counted)
    found = passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), p).collect()
    assert {r["doc_id"]: (r["start"], r["end"], r["source_id"]) for r in found} == {1: (0, 600, 0), 3: (60, 150, 2)}
    assert sum(looked_up) < 200  # the texts have 1,474


def test_open_windows_are_all_that_others_can_hold():
    """Against brute force: every window that an earlier text holds is open, unless a span holds it."""
    p = passages.Passages()
    for case in range(200):
        r = random.Random(case)
        some = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]  # noqa: E731, B023
        text, earlier = some(r.randrange(50, 300)), []
        for _ in range(4):
            a = r.randrange(len(text))
            earlier.append(some(r.randrange(30)) + text[a : a + r.randrange(30, 150)] + some(r.randrange(30)))
        words = [word_hashes(" ".join(t)) for t in (text, *earlier)]
        h, at = passages.seeds(words[0], p.k, p.w)
        known = {int(x) for w in words[1:] for x in passages.seeds(w, p.k, p.w)[0]}
        held = {tuple(t[i : i + p.min_words]) for t in earlier for i in range(len(t) - p.min_words + 1)}
        span = sorted(r.sample(range(len(text) + 1), 2))
        starts, first = passages.open_starts(len(text), h.view("int64"), at, np.array([int(x) in known for x in h]), [tuple(span)], p)
        for i in range(len(text) - p.min_words + 1):
            if tuple(text[i : i + p.min_words]) in held and not (span[0] <= i and i + p.min_words <= span[1]):
                k = starts.tolist().index(i)
                assert i <= at[first[k]] < i + p.w


def test_word_hashes_are_those_of_words():
    """Against a regular expression: as many, equal for equal words alone, whatever lies between them and however long they are."""
    r, seen = random.Random(3), {}
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for n in range(300):
        text = "".join(r.choice(["a", "B", "b", "É", "é", "\x1c", "\x85", "\xa0", "\0", "日", "x" * r.randrange(80), " ", "\n", "\t ", "\r"]) for _ in range(r.randrange(60)))
        words = [w.translate(small) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        hashes = word_hashes(text).tolist()
        assert len(hashes) == len(words), n
        for w, h in zip(words, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_aligned_at_once_as_one_by_one():
    """Chains of a batch, with gaps, edits and text ends, give what aligned() gives for each."""
    p, r, rows, want = passages.Passages(), random.Random(11), [], []
    for n in range(400):
        a = [r.randrange(50 if n % 3 else 3) for _ in range(r.randrange(p.k, 400))]
        b = [r.randrange(50) if r.random() < 0.03 * (n % 4) else x for x in a]
        if n % 5 == 0 and len(b) > 60:
            del b[50]
        b = b[: len(a)] + [7] * max(0, len(a) - len(b))
        at = sorted(r.sample(range(len(a) - p.k + 1), min(len(a) - p.k + 1, r.randrange(1, 6))))
        at = [x for x in at if a[x : x + p.k] == b[x : x + p.k]] or at[:1]
        a0, b0 = max(at[0] - p.margin, 0), max(at[0] - p.margin, 0)
        end = at[-1] + p.k + p.margin
        one, two = np.array(a[a0:end], np.int32), np.array(b[b0:end], np.int32)
        rows.append((n, n + 1000, at, at, a0, b0, one, two))
        got = passages.aligned(at, at, one, two, a0, b0, p)
        if got and all(a[x : x + p.k] == b[x : x + p.k] for x in at):
            want.append((n, got[0], got[1], n + 1000, got[2], got[3], got[4]))
    names = ["doc", "src", "xs", "ys", "a0", "b0", "a", "b"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    found = []
    for low in (0, 150):  # a slice has offsets of its own
        part = passages._aligned_rows(batch.slice(low, 150 if not low else 250), p)
        found += list(zip(*(c.to_pylist() for c in part.columns), strict=True))
    ids = {w[0] for w in want}
    assert sorted(x for x in found if x[0] in ids) == want and len(want) > 150


def test_links_of_like_lines_are_counted_without_their_pairs(spark, monkeypatch):
    """Two groups of edited copies, one with more edits than the other: the numbers of links are the SQL's, but few pairs of lines are made."""
    r, pairs, verified = random.Random(5), [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda docs, own, found, p: pairs.append(found.count()) or verified(docs, own, found, p))
    texts = []
    for k in range(200):  # five of six have one word changed, in a group of their own
        words = prose(90 + (k % 6 == 0), 60).split()
        for _ in range(1 if k % 6 else r.randint(0, 8)):
            words[r.randrange(len(words))] = f"edit{r.randrange(400)}"
        texts.append((k, " ".join(words)))
    names, want = in_duckdb(oracles.op5(), texts, ["doc_id", "text"])
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    same(line_dedup.matches(frame).drop("text_hash"), names, want)
    assert sum(n for *_, n in want) // 2 > 3 * sum(pairs)
