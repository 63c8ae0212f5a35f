"""Text functions on columns: tokens, overlaps, dates, scripts, cleaning."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, markers and patterns that results depend on.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into "
    "through during before after above below between out off over under again further then once here there when where why how all both each few more most "
    "other some such no nor not only own same so than too very just because but and or if while that this these those it its"
).split()
#: What search keywords leave out.
KEYWORD_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from "
    "as into through during before after above below between out off over under again further then once here there when where why how all both each few more most "
    "other some such no nor not only own same so than too very just because but and or if while that this these those it its"
).split()
#: White space in all scripts; its characters below 256 singly, which patterns look up at once. BLANKS: the same, as they are.
SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\p{Z}]"
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What is not yet a single space between words.
UNEVEN = rf"{SPACE}(?:{SPACE}+|(?<!\x20))"
BOILERPLATE = ["cookie", "privacy policy", "terms of service", "subscribe", "newsletter", "sign in", "advertisement", "all rights reserved", "javascript", "enable cookies", "accept all"]
TOKEN = r"([A-Za-zऀ-ൿ]{3,})"
SCRIPTS = {"te": r"[ఀ-౿]", "ta": r"[஀-௿]", "kn": r"[ಀ-೿]", "ml": r"[ഀ-ൿ]", "hi": r"[ऀ-ॿ]"}
MONTH_SHORT = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
MONTH_LONG = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
UNITS = "%|million|billion|crore|lakh|km|kg|m|years?"
#: What may stand before and after a word; both engines of the tests know it, look-around only one.
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

FORMATS = ["yyyy-M-d", "yyyy/M/d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d H:m:s", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f has it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def contains_any(c: Column, tokens: Iterable[str]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(t)) for t in tokens])


def ends_with_any(c: Column, tokens: Iterable[str]) -> Column:
    return reduce(or_, [F.endswith(c, F.lit(t)) for t in tokens])


def filled(c: Column | str) -> Column:
    """The trimmed text, null if nothing is left."""
    t = F.trim(col(c).cast("string"))
    return F.when(t != "", t)


def first_filled(*cs: Column | str) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def to_float(c: Column | str) -> Column:
    return col(c).try_cast("double")


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), UNEVEN, " "))


def norm_key(c: Column | str) -> Column:
    return F.lower(collapse(c))


def words(c: Column | str) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(norm_key(c), " "), lambda w: w != "")


def word_set(c: Column | str, without: list[str] | None = None) -> Column:
    out = F.array_distinct(words(c))
    return F.array_except(out, F.array(*[F.lit(w) for w in without])) if without else out


def token_set(c: Column | str) -> Column:
    """Distinct runs of three or more Latin or Indic letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), 1))


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    either_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(either_empty, 0.0).otherwise(_ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


def overlap_ratio(of: Column, within: Column) -> Column:
    """The share of `within`'s tokens that `of` has."""
    return _ratio(F.size(F.array_intersect(of, within)), F.size(within))


def text_similarity(a: Column, b: Column) -> Column:
    """The largest of the Jaccard likeness and the two containments of word sets."""
    return F.greatest(jaccard(a, b), overlap_ratio(a, b), overlap_ratio(b, a))


def boilerplate_ratio(c: Column | str) -> Column:
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return F.least(F.lit(1.0), reduce(add, [F.regexp_count(t, F.lit(m)) for m in BOILERPLATE]) / F.lit(12.0))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    x = F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, group)
    return F.when(x != "", x)


def entity(c: Column | str) -> Column:
    """The first run of one to four capitalised words."""
    return F.coalesce(F.trim(extract(c, LEFT + r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})" + RIGHT)), F.lit(""))


#: Dates and numbers have one: a text without is not searched pattern by pattern.
DIGIT = r"\p{Nd}"
DATE_PATTERNS = [
    LEFT + r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})" + RIGHT,
    "(?i)" + LEFT + rf"(\d{{1,2}}\s+{MONTH_SHORT}[a-z]*\s+\d{{4}})" + RIGHT,
    "(?i)" + LEFT + rf"({MONTH_SHORT}[a-z]*\s+\d{{1,2}},\s+\d{{4}})" + RIGHT,
    LEFT + r"(20\d{2}|19\d{2})" + RIGHT,
]


def first_date(c: Column | str) -> Column:
    return F.when(col(c).rlike(DIGIT), F.coalesce(*[extract(c, p) for p in DATE_PATTERNS], F.lit(""))).otherwise("")


NUMERIC = rf"\b(\d[\d,]*(?:\.\d+)?(?:\s?(?:{UNITS}))?)\b"


def numeric_claim(c: Column | str) -> Column:
    """The first number with its unit. It ends at a word's edge, so that a % counts only before a letter or digit."""
    return F.when(col(c).rlike(DIGIT), F.coalesce(F.trim(extract(c, "(?iU)" + NUMERIC)), F.lit(""))).otherwise("")


TEXT_DATES = [
    "(?i)" + LEFT + rf"({MONTH_LONG}\s+\d{{1,2}},\s+\d{{4}})" + RIGHT,
    "(?i)" + LEFT + rf"(\d{{1,2}}\s+{MONTH_LONG}\s+\d{{4}})" + RIGHT,
    DATE_PATTERNS[0],
]


def date_in_text(c: Column | str) -> Column:
    return F.coalesce(*[extract(c, p) for p in TEXT_DATES], F.lit(""))


def published_at(c: Column | str) -> Column:
    """An ISO date and time from nine formats; what begins like an ISO date stays; else empty."""
    raw = F.trim(F.coalesce(col(c), F.lit("")))
    t = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in FORMATS])
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), raw), F.lit(""))


def title_key(c: Column | str) -> Column:
    t = norm_key(c)
    return F.when(F.length(t) < 24, "").otherwise(F.substring(t, 1, 200))


def text_key(c: Column | str, n: int) -> Column:
    return F.substring(norm_key(c), 1, n)


def english_like(c: Column | str) -> Column:
    """At least four fifths of the letters are ASCII; true without letters."""
    letters = F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"\p{L}"))
    return F.when(letters == 0, True).otherwise(F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit("[A-Za-z]")) / letters >= 0.8)


def script_count(c: Column | str, lang: str) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(SCRIPTS[lang]))


def latin_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit("[A-Za-z]"))


def detect_language(c: Column | str, requested: Column | str) -> Column:
    """What was requested unless blank, auto or en; else the first script that occurs, in the order te, ta, kn, ml, hi; else en."""
    want = F.lower(F.trim(F.coalesce(col(requested), F.lit(""))))
    found = F.coalesce(*[F.when(col(c).rlike(p), k) for k, p in SCRIPTS.items()], F.lit("en"))
    return F.when(want.isin("", "auto", "en"), found).otherwise(want)


def looks_multilingual(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike("|".join(SCRIPTS.values()))


def language_ok(c: Column | str, lang: Column | str) -> Column:
    """English: eight Latin letters. Others: twelve of their script and at most max(8, a quarter of those) Latin ones."""
    n = reduce(lambda x, k: F.when(col(lang) == k, script_count(c, k)).otherwise(x), SCRIPTS, F.lit(0))
    latin = latin_count(c)
    return F.when(col(lang) == "en", latin >= 8).otherwise((n >= 12) & (latin <= F.greatest(F.lit(8), F.floor(n * 0.25))))


def clean_claim(c: Column | str) -> Column:
    """White space collapsed, then zero-width characters dropped. Quotes stay as they are."""
    return F.regexp_replace(collapse(c), "[​-‍﻿]", "")


def ocr_clean(c: Column | str) -> Column:
    """White space collapsed, none before and one after every mark, also within numbers."""
    t = collapse(c)
    t = F.regexp_replace(t, r"\s+([,.;:!?])", "$1")
    return collapse(F.regexp_replace(t, r"([,.;:!?])", "$1 "))


def to_question(c: Column | str) -> Column:
    """A claim that ends in a question mark as it is, another without the space and marks at its end, asked for; as it is where
    nothing else is left."""
    t = F.coalesce(col(c), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(t, SPACE + r"+\z", ""), r"[.!;:]+\z", "")
    return F.when(F.endswith(t, F.lit("?")) | (body == ""), t).otherwise(F.concat(F.lit("Is it true that "), body, F.lit("?")))


def keywords(c: Column | str, most: int = 10) -> Column:
    """The first ten words, in their case, that are no stop words, have two characters and begin with a letter or digit, joined."""
    ok = F.filter(F.split(collapse(c), " "), lambda w: (~F.lower(w).isin(*KEYWORD_STOPWORDS)) & (F.length(w) > 1) & w.rlike(r"^[\p{L}\p{N}]"))
    return F.array_join(F.slice(ok, 1, most), " ")


def ascii_anchors(c: Column | str, most: int = 10) -> Column:
    """Latin words and numbers of two characters or more, each once whatever its case, in order, at most ten."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9._/-]*|\p{Nd}+(?:[.,]\p{Nd}+)?(?:%|[A-Za-z]+)?"), F.lit(0))
    new = lambda kept, x: (F.size(kept) < most) & (F.length(x) >= 2) & ~F.exists(kept, lambda y: F.lower(y) == F.lower(x))
    return F.reduce(found, F.array().cast("array<string>"), lambda kept, x: F.when(new(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def unique_queries(qs: Column, most: int) -> Column:
    """The first of queries that are equal but for case and space, blanks dropped, at most so many."""
    clean = F.filter(F.transform(qs, collapse), lambda x: x != "")
    first = F.filter(F.transform(clean, lambda x, i: F.when(F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.slice(first, 1, most)


def clip_words(c: Column | str, most: int = 240, least: float = 0.6) -> Column:
    """Cut at `most` characters, at the last space if that keeps the share `least`."""
    t = collapse(c)
    cut = F.substring(t, 1, most)
    at = most - F.instr(F.reverse(cut), " ")
    return F.when(F.length(t) <= most, t).otherwise(F.trim(F.when((F.instr(cut, " ") > 0) & (at >= most * least), F.substring(cut, F.lit(1), at)).otherwise(cut)))


def numeric_id(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c).cast("string"), F.lit("")), r"(\d+)$", 1).try_cast("bigint")


def fact_span(text: Column | str, claim_tokens: Column) -> Column:
    """Sentences that share a token with the claim, or have a date or number, until over 700 characters; at most 900.

    The first sentence where none does; its first 700 characters where the claim has no tokens.
    """
    s = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    good = lambda x: F.arrays_overlap(token_set(x), claim_tokens) | (first_date(x) != "") | (numeric_claim(x) != "")
    # sentences that come after 700 characters are not looked at
    run = F.aggregate(s, F.lit(""), lambda a, x: F.when((F.length(a) <= 700) & good(x), F.when(a == "", x).otherwise(F.concat(a, F.lit(" "), x))).otherwise(a))
    head = F.coalesce(F.get(s, F.lit(0)), F.lit(""))
    return F.when(F.size(claim_tokens) == 0, F.substring(head, 1, 700)).otherwise(F.substring(F.when(run != "", run).otherwise(head), 1, 900))


def snippets(items: Column, most: int = 320) -> Column:
    """Numbered lines of an array of structs (source, relevance, text) in its order."""
    return F.array_join(F.transform(items, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] source="), e["source"], F.lit("; relevance="), F.format_number(e["relevance"], 2), F.lit("; text="), F.substring(e["text"], 1, most))), "\n")


def pieces(c: Column, marks: str) -> Column:
    """The text parted at line breaks and at white space after end marks, which stay; pieces may be blank."""
    return F.split(c, rf"{SPACE}(?<=\n|[{marks}]{SPACE}){SPACE}*")


def sentence_pieces(c: Column) -> Column:
    """Pieces over several scripts, some of them blank."""
    bars = lambda t: F.when(contains_any(t, "|•‣▪"), F.regexp_replace(t, r"[|]+|[•‣▪]+", ". ")).otherwise(t)
    stops = lambda t: F.when(contains_any(t, "。॥"), F.regexp_replace(t, "[。॥]+", "। ")).otherwise(t)
    return pieces(once(once(c, bars), stops), ".!?।;:")


def sentences(c: Column | str) -> Column:
    """Sentence pieces over several scripts: line breaks, end marks, colons and semicolons before white space, bullets and bars
    end a sentence; full stops of East Asian texts and double bars count as a danda."""
    return F.filter(F.transform(sentence_pieces(F.coalesce(col(c), F.lit(""))), lambda x: stripped(x)), lambda x: x != "")


def stripped(c: Column | str, also: str = "") -> Column:
    """Without white space and the characters `also` at both ends."""
    return F.btrim(col(c), F.lit(BLANKS + also))


def word_count(c: Column | str, spaced: bool = False) -> Column:
    """Runs between white space. Where that is single spaces, these are counted. spaced: it is spaces, and none at the ends."""
    runs = lambda t: F.regexp_count(t, F.lit(f"[^{SPACE[1:-1]}]+"))
    count = lambda t: F.when(t == "", 0).when(F.contains(t, F.lit("  ")) if spaced else t.rlike(UNEVEN), runs(t)).otherwise(spaces(t) + 1)
    return count(col(c)) if spaced else once(stripped(c), count)


def spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


# Beginnings that are no sentences, cues of sentences and of facts, and what recognition leaves at a line's start.
NOT_SENTENCE = r"^(?:figure|fig\.|table|chart|source|note|page|section)\b"
SENTENCE_VERBS = "is are was were has have had will can caused causes lead leads resulted result reported shows showed indicates indicated specifies states includes".split()
FACT_VERBS = "is are was were has have had includes include specifies states reported caused occurred recorded announced killed affected".split()
OCR_PREFIX = r"(?i)^(?:py\)|@o\d+|ocr|ai)\s*[:\-)]?\s*"
SENTENCE_LETTERS = r"[A-Za-z\u0900-\u097F\u0B80-\u0BFF\u0C00-\u0CFF\u0D00-\u0D7F]"


def sentence_like(c: Column | str) -> Column:
    """Not the line of a figure, table or source, and with an end mark, a verb cue, or a comma, colon or semicolon."""
    return once(stripped(c), shaped)


def shaped(t: Column) -> Column:
    """sentence_like of a text that is stripped."""
    head = F.lower(F.substring(t, 1, 16))  # longer than any beginning that is no sentence
    verbs = F.arrays_overlap(F.regexp_extract_all(F.lower(t), F.lit("([A-Za-z']+)"), F.lit(1)), F.array(*[F.lit(v) for v in SENTENCE_VERBS]))
    return (t != "") & ~head.rlike("(?U)" + NOT_SENTENCE) & (ends_with_any(t, ".!?।") | contains_any(t, ",:;") | verbs)


def verifiable(c: Column | str) -> Column:
    """With a number of up to four digits, a sign of money or percent, a verb of facts anywhere, or a capitalised word."""
    verb = once(F.lower(col(c)), lambda low: contains_any(low, FACT_VERBS))
    return verb | contains_any(col(c), "%₹$") | col(c).rlike(r"(?U)\b\d{1,4}\b") | col(c).rlike(r"(?U)[A-Z](?<=\b[A-Z])[a-z]+\b")


def claim_sentences(c: Column | str, least: int = 0) -> Column:
    """Sentences of a document for claims: dotted abbreviations hold together, bullets, dashes and what recognition left at
    the start go. Pieces of fewer than `least` words are dropped before they are cleaned, which adds none."""
    # patterns begin with what is rare: the dot, then what stands before it
    dotted = r"(?U)\.(?<=\b[A-Za-z]\.)"
    held = lambda t: F.regexp_replace(collapse(F.regexp_replace(t, dotted + r"\s+([A-Za-z])\.\b", ".$1.")), dotted + r"((?:[A-Za-z]\.)+)", ".$1\u0001")
    t = once(F.coalesce(col(c), F.lit("")), lambda t: F.when(t.rlike(dotted), held(t)).otherwise(collapse(t)))
    clean = lambda x: stripped(F.regexp_replace(F.replace(stripped(x, "-–—•*"), F.lit("\u0001"), F.lit("")), OCR_PREFIX, ""))
    parts = sentence_pieces(t)
    if least > 1:  # white space is single spaces here
        parts = F.filter(parts, lambda x: (F.octet_length(x) >= 2 * least - 1) & (spaces(x) >= least - 1))
    return F.filter(F.transform(parts, clean), lambda x: x != "")


def repaired(c: Column | str) -> Column:
    """UTF-8 of an Indic script that was read as Latin-1, where its marks occur; what cannot be read is dropped."""
    t = col(c)
    fixed = F.trim(F.replace(F.decode(F.encode(F.regexp_replace(t, r"[^\x00-\xff]", ""), "ISO-8859-1"), "UTF-8"), F.lit("\ufffd"), F.lit("")))
    return F.when(t.rlike("à¤|à®|à°|à²|à´") & (fixed != ""), fixed).otherwise(t)


def without_artefact(c: Column | str) -> Column:
    """A claim without the sentence that names its language at the end."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"(?i)\s+this\s+claim\s+is\s+(?:provided|presented)\s+in\s+[a-z]+\.?\s*$", ""))
