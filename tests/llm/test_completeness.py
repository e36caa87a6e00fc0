"""Inputs on which an operator once did less than its whole job."""

from math import comb

import pytest
from tokenizers import Tokenizer

from auditlake.llm import line_dedup, main_text, near_duplicates, passages
from auditlake.llm.tokens import Encoder, public_path

from .conftest import prose


def _line_pairs(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["match_doc_id"]) for r in line_dedup.matches(frame).collect()}


def test_edited_lines_are_near_duplicates(spark):
    line = [f"w{i}" for i in range(18)]
    short = "one two three four five six seven".split()
    texts = [" ".join(x) for x in (line, [*line[:9], "new", *line[10:]], short, [*short, "eight"], ["a", "b", "c", "d"], ["a", "b", "x", "y"])]
    assert _line_pairs(spark, texts) == {(1, 0), (3, 2)}


def test_short_lines_recur(spark):
    texts = ["Of.", "yes yes yes", "Of.", "so be", "be so be", "yes", "", "", " ", "so"]
    assert _line_pairs(spark, texts) == {(2, 0), (4, 3), (5, 1)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_keep_their_ids(name):
    with open(public_path(name), encoding="utf-8") as f:
        code = Encoder(f.read())
    library = Tokenizer.from_file(public_path(name))
    texts = [f"a{gap}{token}{gap}Éx, y" for token in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext") for gap in ("", " ", "\n", "  ", "日本 ")]
    for text in [*texts, "it's  a text", "<|endoftext|>" * 3, "ab\n\nc <| d |>"]:
        assert code.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(code.ids("<|endoftext|>")) == 1


@pytest.mark.parametrize("n", [20, 30, 40])
def test_passages_of_lines_seen_earlier(spark, n):
    """Three lines in a row that two documents share; each line alone is in an earlier document too."""
    rows, spans = [], {}
    for i in range(60):
        lines = [prose(10_000 * n + 10 * i + k, n) for k in range(3)]
        rows += [(3 * i + k, f"{prose(5_000_000 + 3 * i + k, 15)} {line} {prose(6_000_000 + 3 * i + k, 15)}") for k, line in enumerate(lines)]
        rows += [(a + i, f"{prose(b + i, 40)} {' '.join(lines)} {prose(b + 500 + i, 40)}") for a, b in ((1000, 7_000_000), (2000, 8_000_000))]
    for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert [i for i in range(60) if not set(range(40, 40 + 3 * n)) <= spans.get(2000 + i, set())] == []


def test_recall_at_full_depth():
    """Pairs at the threshold that all trees miss, in branches that stay large through all levels."""
    j = near_duplicates.Join()
    t, missed = j.percent / 100, 0.0
    chance = lambda n, k: comb(n, k) * t**k * (1 - t) ** (n - k)
    for first in range(j.trees + 1):  # trees whose first token the pair shares, and the other tokens that it shares
        for more in range(j.width - j.trees + 1):
            share, lost = (first + more) / j.width, 0.0
            for _ in range(j.depth):
                lost = (1 - share + share * lost) ** j.branches
            missed += chance(j.trees, first) * chance(j.width - j.trees, more) * lost**first
    assert missed < 1e-6


@pytest.mark.parametrize(
    "page, text",
    [
        # an option that nothing closes ends at the next block
        ("<article><p>Before it.</p><select><option>A<option>B</select><p>After it.</p></article>", "Before it.\nAfter it."),
        ("<article><p>Before it.</p><option>x<p>After it.</p></article>", "Before it.\nAfter it."),
        # classes that only end in a word, or name the topic of a post
        ("<article><div class='overflow-hidden'><p>Shown text.</p></div></article>", "Shown text."),
        ("<article><div class='post legal'><p>On the law.</p></div></article>", "On the law."),
        # marked paragraphs and headings inside an article
        (
            "<article><p class='advert'>Buy this.</p><p>One.</p><h2 class=newsletter>Join us.</h2><p>Two.</p><p hidden>No.</p><p>Three.</p></article>",
            "One.\nTwo.\nThree.",
        ),
        # unmarked blocks
        (f"<body><div>{'long ' * 40}</div><div>{'text ' * 13}</div><div>Short.</div></body>", f"{('long ' * 40).strip()}\n{('text ' * 13).strip()}"),
    ],
)
def test_blocks_of_an_article(page, text):
    assert main_text.main_text(page) == text
