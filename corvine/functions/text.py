"""Text expressions: blanks, tokenizers, sentences and estimates. Inventory 5-7, 29-30, 33, 113-124, 131."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank when text is stripped, beyond Java's \s.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Where a line ends.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# The three word lists and token patterns, which results depend on.
TERM = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*"
SEARCH_STOPWORDS = tuple(
    "a about above after again against all am an and any are aren as at be because been "
    "before being below between both but by can cannot could couldn did didn do does "
    "doesn doing don down during each few for from further had hadn has hasn have haven "
    "having he her here hers herself him himself his how i if in into is isn it its "
    "itself just me more most mustn my myself no nor not now of off on once only or "
    "other ought our ours ourselves out over own same shan she should shouldn so some "
    "such than that the their theirs them themselves then there these they this those "
    "through to too under until up very was wasn we were weren what when where which "
    "while who whom why will with won would wouldn you your yours yourself yourselves".split()
)
QUESTION_WORD = r"[a-z0-9]+"
QUESTION_STOPWORDS = tuple("about does explain from have into that the this what when where which with why".split())
JUDGE_WORD = r"[a-z0-9_]+"
JUDGE_STOPWORDS = tuple(
    "a an and are as at be but by for from has have how in is it its of on or that the "
    "their there these this to was were what when where which who why will with does do".split()
)
SENTENCE_END = r"(?<=[.!?])\s+"
CLAIM_SPLIT = r"(?<=[.!?])\s+(?!\[\d)"
LEAST_CLAIM_CHARS = 24


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


#: Lower-case characters whose caseless form is or holds ASCII letters; only those matter for terms.
CASELESS = {
    "ß": "ss", "\u017f": "s", "\u0149": "\u02bcn", "\u01f0": "j\u030c", "\u1e96": "h\u0331", "\u1e97": "t\u0308", "\u1e98": "w\u030a", "\u1e99": "y\u030a", "\u1e9a": "a\u02be",
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
}


#: First bytes in UTF-8 of the characters above, in groups; a text without any of them has none of those.
CASELESS_BYTES = ("C39F", "C5BF", "C589", "C7B0", "E1BA", "EFAC")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` may use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold(c: Column) -> Column:
    """Lower case with characters that stand for others written out, as caseless matching has it, where it matters for terms.

    ASCII texts, and those in which plain byte searches find none of these characters, are only lower-cased.
    """
    def written_out(low: Column) -> Column:
        out = low
        for x, to in CASELESS.items():
            out = F.replace(out, F.lit(x), F.lit(to))
        raw = low.cast("binary")
        some = reduce(lambda a, b: a | b, (F.contains(raw, F.unhex(F.lit(h))) for h in CASELESS_BYTES))
        return F.when(~is_ascii(low) & some, out).otherwise(low)

    return let(F.lower(c), written_out)


def _find(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _without(words: Column, stop: tuple[str, ...]) -> Column:
    return F.array_except(words, F.array(*map(F.lit, stop)))


def search_terms(c: Column, stopwords: tuple[str, ...] = SEARCH_STOPWORDS, lowercase: bool = True) -> Column:
    """Terms in text order, with repeats, without stopwords."""
    words = _find(fold(c) if lowercase else c, TERM)
    return F.filter(words, lambda w: ~w.isin(list(stopwords))) if stopwords else words


def question_terms(c: Column) -> Column:
    """Distinct words of four or more characters that are not question words."""
    return F.filter(_without(_find(F.lower(c), QUESTION_WORD), QUESTION_STOPWORDS), lambda w: F.length(w) >= 4)


def judge_words(c: Column) -> Column:
    """Distinct content words with citation markers taken out."""
    return _without(_find(F.regexp_replace(F.lower(c), r"\[\d+\]", " "), JUDGE_WORD), JUDGE_STOPWORDS)


def share(part: Column, whole: Column) -> Column:
    """Part of the distinct words of ``part`` that ``whole`` has; null if there are none."""
    return F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0))


def first_sentence(c: Column) -> Column:
    flat = F.trim(F.regexp_replace(c, f"{BLANK}+", " "))
    return F.trim(F.get(F.split(flat, SENTENCE_END, 2), F.lit(0)))


def cite(sentence: Column, marker: Column) -> Column:
    """``[n]`` inside the sentence, before its final punctuation, or with a full stop after it."""
    tag = F.concat(F.lit(" ["), marker.cast("string"), F.lit("]"))
    body = F.rtrim(F.regexp_replace(sentence, r"[.!?]$", ""))
    return F.when(sentence.rlike(r"[.!?]$"), F.concat(body, tag, F.right(sentence, F.lit(1)))).otherwise(F.concat(sentence, tag, F.lit(".")))


def uncited_claims(answer: Column) -> Column:
    parts = F.transform(F.split(strip(answer), CLAIM_SPLIT), strip)
    return F.filter(parts, lambda s: (F.length(s) >= LEAST_CLAIM_CHARS) & ~s.rlike(r"\[\d+\]"))


def tidy(c: Column) -> Column:
    """Close the gaps that removed markers leave."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\s+([.,;:!?])", "$1"), r"[ \t]{2,}", " "))


def stream_pieces(c: Column) -> Column:
    """Cut behind each single space; the pieces' concatenation is the text."""
    words = F.split(c, " ")
    return F.filter(F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.concat(w, F.lit(" "))).otherwise(w)), lambda w: w != "")


def chunk_token_estimate(c: Column) -> Column:
    """A token for each started four characters."""
    return F.floor((F.length(c) + 3) / 4).cast("int")


def prompt_token_estimate(c: Column) -> Column:
    """One more than the whole fours of characters; on purpose another formula than for chunks."""
    return (F.floor(F.length(c) / 4) + 1).cast("int")


def embed_text(text: Column, title: Column, heading_path: Column) -> Column:
    """Title and headings, without those that repeat it, above the text."""
    heads = F.filter(F.coalesce(heading_path, F.array().cast("array<string>")), lambda h: title.isNull() | (h != title))
    titled = F.when(F.coalesce(title, F.lit("")) != "", F.array(title)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(titled, heads)
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " > "), F.lit("\n\n"), text)).otherwise(text)


def first_h1(text: Column) -> Column:
    """Text of the first line that starts with ``# `` and has any."""
    heads = F.filter(F.split(text, LINE_BREAK), lambda x: x.startswith("# "))
    heads = F.transform(heads, lambda x: strip(F.regexp_replace(strip(F.substr(x, F.lit(3))), "#+$", "")))
    return F.get(F.filter(heads, lambda h: h != ""), F.lit(0))


def tag_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def normal_path(c: Column) -> Column:
    """Forward slashes, no leading slash, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", ""), r"^(?:\./)+", "")


def source_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("root"))
