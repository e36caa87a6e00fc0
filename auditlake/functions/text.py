"""Text measures as SQL expressions: words, sentences, readability, language votes, SERP width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word, and shingle-token patterns over lower-cased text (the second holds U+00F7 too).
WORD = r"[a-zà-ÿ0-9][a-zà-ÿ0-9'-]+"
TOKEN = r"[a-zà-ÿ0-9]+"
_WORD_SQL = WORD.replace("'", "\\'")
VOWELS = "aeiouyàáâãäåèéêëìíîïòóôõöøùúûüýÿ"

#: Stop words of the language vote; ties go to the language listed first.
LANGUAGE_WORDS = {
    "nl": "de het een en van ik je dat die niet met is op te voor aan er om ook maar naar zijn was heeft wordt deze "
    "bij of als uit over wij hebben kan worden geen meer onze ze dit",
    "en": "the and of to a in is that it for was on are with as be at this have from or an they you not but what all "
    "were when we your can more has our their which",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "dass sie nach wird bei einen wir oder haben sind über einer",
}

#: Keyword stop words.
KEYWORD_STOP = (
    "de het een en van in op te dat die is was zijn voor met als aan er om ook maar uit bij nog naar dan je jij u we "
    "wij ze zij ik hij hem haar hun ons onze mijn jouw uw dit deze daar hier wat wie waar hoe niet geen wel al alle "
    "alles iets niets veel meer meest minder zo toch dus want of over onder tussen door tegen na tot per via wordt "
    "worden werd werden heeft hebben had hadden kan kunnen kon kunt zal zullen zou zouden moet moeten mag mogen doet "
    "doen deed gaan gaat ging komen komt kwam maken maakt nieuw nieuwe goed goede groot grote klein kleine eigen elke "
    "elk iedere ieder zelf zonder binnen the a an and or of to in on at for with as by from is are was were be been "
    "being this that these those it its it's i you he she we they them his her their our your my me him us do does "
    "did done have has had having will would can could shall should may might must not no nor so if then than too "
    "very just about into over under again further once here there when where why how all any both each few more "
    "most other some such only own same s t don now"
).split()

#: Markers of placeholder text.
PLACEHOLDERS = (
    "lorem ipsum", "lorem", "dolor sit amet", "consectetur adipiscing", "your text here", "your text",
    "insert text here", "enter text here", "dummy text", "sample text", "placeholder text", "voorbeeldtekst hier",
)

#: Widths of the Helvetica characters in thousandths of an em; other characters are 556 wide.
WIDTHS = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^",
    500: "Jckvxsyz", 556: "#$0123456789?L_abdeghnopqu", 584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw",
    778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
TITLE_FONT, TITLE_LIMIT, DESCRIPTION_FONT, DESCRIPTION_LIMIT = 20, 580, 14, 920


def quoted(words) -> str:
    return ",".join("'" + w.replace("'", "''") + "'" for w in words)


def lowered(text: str) -> str:
    """Lower case, one character for each: U+0130 alone would become two."""
    return f"lower(replace({text}, '\u0130', 'i'))"


def words(text: str) -> str:
    """Lower-cased words of a SQL string expression."""
    return f"regexp_extract_all({lowered(text)}, '{_WORD_SQL}', 0)"


def shingle_tokens(text: str) -> str:
    return f"regexp_extract_all({lowered(text)}, '{TOKEN}', 0)"


def rounded(number: str, digits: int) -> str:
    """A double to so many decimals as DuckDB rounds it: the scaled double, halves away from zero.

    Spark's round() takes the shortest decimal notation instead, which parts from it next to a half.
    """
    return f"(round({number} * 1e{digits}D, 0) / 1e{digits}D)"


def sentence_count(text: str) -> str:
    return f"greatest(1, size(filter(split({text}, '[.!?]+'), s -> trim(regexp_replace(s, '[ \\\\t-\\\\r]+', ' ')) <> '')))"


def syllables(word: str) -> str:
    """Vowel groups, at least one."""
    return f"greatest(1, size(regexp_extract_all({word}, '[{VOWELS}]+', 0)))"


def language(found: str) -> str:
    """Votes of the first 2500 words; null for fewer than 20 words or no vote."""
    vote = {k: f"size(filter(slice({found}, 1, 2500), w -> w in ({quoted(v.split())})))" for k, v in LANGUAGE_WORDS.items()}
    best = f"greatest({', '.join(vote.values())})"
    return (
        f"case when size({found}) < 20 or {best} = 0 then null "
        + " ".join(f"when {v} = {best} then '{k}'" for k, v in vote.items())
        + " end"
    )


def flesch(n_words: str, n_sentences: str, n_syllables: str, lang: str) -> str:
    """Reading ease, one decimal; the Dutch variant for nl. Null under 30 words."""
    asl, asw = f"({n_words} / {n_sentences})", f"({n_syllables} / {n_words})"
    return (
        f"case when {n_words} < 30 then null when {lang} = 'nl' then {rounded(f'(206.84D - 0.93D * {asl} - 77D * {asw})', 1)} "
        f"else {rounded(f'(206.835D - 1.015D * {asl} - 84.6D * {asw})', 1)} end"
    )


#: Lower limits of the reading classes.
READING = ((90, "zeer makkelijk"), (80, "makkelijk"), (70, "vrij makkelijk"), (60, "standaard"), (50, "vrij moeilijk"), (30, "moeilijk"))


def reading_class(score: str) -> str:
    steps = " ".join(f"when {score} >= {low} then '{name}'" for low, name in READING)
    return f"case when {score} is null then null {steps} else 'zeer moeilijk' end"


#: A character inside a class of a pattern inside a SQL string.
_CLASS = {"\\": "\\" * 4, "]": "\\\\]", "^": "\\\\^", "-": "\\\\-", "[": "\\\\[", "'": "\\'"}


def thousandths(text: str) -> str:
    """Sum of the character widths: of all characters as 556, corrected for those that differ."""
    terms = []
    for width, chars in WIDTHS.items():
        if width != 556:
            listed = "".join(_CLASS.get(c, c) for c in chars)
            terms.append(f"{width - 556} * (char_length({text}) - char_length(regexp_replace({text}, '[{listed}]', '')))")
    return f"(556 * char_length({text}) + " + " + ".join(terms) + ")"


def pixel_width(text: str, font: int) -> str:
    return f"cast(bround({thousandths(text)} / 1000.0D * {font}) as int)"


def description_issue(text: str) -> str:
    wide = f"{pixel_width(text, DESCRIPTION_FONT)} > {DESCRIPTION_LIMIT}"
    return (
        f"case when coalesce({text}, '') = '' then 'ontbreekt' when char_length({text}) < 70 then 'te_kort' "
        f"when char_length({text}) > 160 or {wide} then 'te_lang' end"
    )


def placeholder(text: str) -> Column:
    return F.expr(f"exists(array({quoted(PLACEHOLDERS)}), m -> contains(lower({text}), m))")


def ngrams(tokens: str, n: int) -> str:
    """Runs of n words that neither begin nor end with a stop word and aren't all digits; for n = 1 words over two letters."""
    stop = quoted(KEYWORD_STOP)
    if n == 1:
        return f"filter({tokens}, w -> w not in ({stop}) and not w rlike '^[0-9]+$' and char_length(w) > 2)"
    grams = f"transform(sequence(1, size({tokens}) - {n - 1}), i -> slice({tokens}, i, {n}))"
    fit = f"g[0] not in ({stop}) and g[{n - 1}] not in ({stop}) and not forall(g, w -> w rlike '^[0-9]+$')"
    return f"case when size({tokens}) >= {n} then transform(filter({grams}, g -> {fit}), g -> array_join(g, ' ')) else array() end"


def shingles(tokens: str, k: int = 5) -> str:
    """Distinct k-word shingles in order, as 64-bit hashes; the distinct words of a shorter text."""
    hashes = f"transform({tokens}, x -> xxhash64(x))"
    long = f"transform(array({hashes}), h -> transform(sequence(1, size(h) - {k - 1}), i -> xxhash64(slice(h, i, {k}))))[0]"
    return f"array_distinct(case when size({tokens}) >= {k} then {long} else {hashes} end)"
