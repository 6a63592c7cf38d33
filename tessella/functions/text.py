"""Text functions as column expressions. ASCII classes unless said otherwise, so results don't depend on the regex engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic characters and their plain forms.
CURLY = "‘’‚“”„–—− "
PLAIN = "'''\"\"\"--- "
#: Texts that stand for a missing value.
NULL_WORDS = ("", "null", "none", "n/a", "unknown", "undetected")
STOPWORDS = tuple("a an and are as at be by for from in is it of on or that the this to was were with".split())
EMPTY_STRINGS = "cast(array() as array<string>)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_punctuation(c) -> Column:
    return F.translate(col(c), CURLY, PLAIN)


def squeeze(c) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize(c) -> Column:
    return squeeze(fold_punctuation(c))


def repair(c) -> Column:
    """Drop U+FFFD and soft hyphens, squeeze."""
    return squeeze(F.translate(col(c), "�­", ""))


def mojibake(c) -> Column:
    """U+FFFD between letters is an apostrophe."""
    return F.regexp_replace(col(c), "(?<=[A-Za-z])�(?=[A-Za-z])", "'")


def quote_stripped(c) -> Column:
    return squeeze(F.lower(F.regexp_replace(fold_punctuation(c), "['\"`]", "")))


def null_collapse(c) -> Column:
    return F.when(F.lower(F.trim(col(c))).isin(*NULL_WORDS), None).otherwise(F.trim(col(c)))


def key(c) -> Column:
    """Lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "&", " and "), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_stem(c) -> Column:
    """A title up to its amendment note or its kind of instrument."""
    return key(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"\s*\(amendment.*$", ""), r"\b(ordinance|act|law)\b.*$", ""))


def normal_title(c) -> Column:
    return F.regexp_replace(F.regexp_replace(key(c), "^the ", ""), " (act|ordinance|law)$", "")


def title_case(c, small: tuple[str, ...] = ("of", "and", "the", "in", "for", "to")) -> Column:
    words = F.split(F.lower(squeeze(c)), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10**6)))), " ")


def acronym(c) -> Column:
    words = F.filter(F.split(key(c), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(c, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Tokens without stopwords; all of them if nothing is left."""
    return let(tokens(c), lambda t: let(F.filter(t, lambda w: ~w.isin(*stop)), lambda k: F.when(F.size(k) == 0, t).otherwise(k)))


def query_tokens(c, shortest: int = 3) -> Column:
    """Distinct content tokens of at least `shortest` letters, in order."""
    return F.array_distinct(F.filter(tokens(c), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) >= shortest)))


def sentences(c) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(col(c), F.lit("[^.!?]+[.!?]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def chunks(c, size: int = 1800, step: int = 1500, least: int = 200, most: int | None = 16) -> Column:
    """Array of (k, chunk): overlapping windows; a tail under `least` goes unless it is the first; `most` is the reference's cap, None for none."""
    starts = F.when(F.length(col(c)) > 0, F.sequence(F.lit(0), F.length(col(c)) - 1, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))
    parts = F.transform(starts, lambda s, k: F.struct(k.alias("k"), F.substring(col(c), s + 1, F.lit(size)).alias("chunk")))
    kept = F.filter(parts, lambda p: (p["k"] == 0) | (F.length(p["chunk"]) >= least))
    return kept if most is None else F.slice(kept, 1, most)


def strip_html(c) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return squeeze(bare)


def masked_window(text, quote, citation, around: int = 400) -> Column:
    """(query, how): what stands around a quote, with the citation masked, else the quote; else the head of the text."""
    t, q, c = col(text), col(quote), col(citation)
    at = F.instr(t, q)
    window = F.substring(t, F.greatest(at - around, F.lit(1)), F.length(q) + 2 * around)
    return F.when((at > 0) & (q != "") & F.contains(window, c) & (c != ""), F.struct(squeeze(F.replace(window, c, F.lit(" "))).alias("query"), F.lit("window-citation-masked").alias("how"))).when(
        (at > 0) & (q != ""), F.struct(squeeze(F.replace(window, q, F.lit(" "))).alias("query"), F.lit("window-quote-masked").alias("how"))
    ).otherwise(F.struct(squeeze(F.substring(t, 1, 2 * around)).alias("query"), F.lit("held-sentence-fallback").alias("how")))


def grounded(quote, text, least: int = 15) -> Column:
    """Whether a quote of at least `least` characters stands in the text verbatim, after normalising."""
    return let(quote_stripped(quote), lambda q: (F.length(q) >= least) & F.contains(quote_stripped(text), q))


def lexicon_hits(c, terms: tuple[str, ...]) -> Column:
    """Terms (single words) that occur."""
    return F.array_intersect(tokens(c), F.array(*map(F.lit, terms)))


def gate(c, strong: tuple[str, ...], lexicon: tuple[str, ...], at_least: int = 3) -> Column:
    """(strong, lex, score, passed): passed with one strong term or enough of the lexicon."""
    return let(
        F.struct(F.size(lexicon_hits(c, strong)).alias("strong"), F.size(lexicon_hits(c, lexicon)).alias("lex")),
        lambda g: F.struct(g["strong"], g["lex"], (3 * g["strong"] + g["lex"]).alias("score"), ((g["strong"] >= 1) | (g["lex"] >= at_least)).alias("passed")),
    )


def script_of(c, mixed: float = 0.15) -> Column:
    """latin, extended or mixed, by share of ASCII and other letters."""
    ascii_n, other = F.length(F.regexp_replace(col(c), "[^A-Za-z]", "")), F.length(F.regexp_replace(col(c), r"[\x00-\x7F]", ""))
    share = other / F.greatest(ascii_n + other, F.lit(1))
    return F.when(ascii_n + other == 0, "none").when(share >= 1 - mixed, "extended").when(share >= mixed, "mixed").otherwise("latin")


def lf_hash(c) -> Column:
    """SHA-256 with line ends as LF."""
    return F.sha2(F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), 256)


def year_of(c) -> Column:
    return F.when(F.regexp_like(F.trim(col(c)), F.lit(r"^\d+$")), F.trim(col(c)).try_cast("int"))


def first_number_pair(c) -> Column:
    """(number, year) of "79 of 1988" or "20 1977"."""
    a, b = (lambda g: F.regexp_extract(col(c), r"(\d+)\s+of\s+(\d{4})", g)), (lambda g: F.regexp_extract(col(c), r"(\d+)\s+(\d{4})", g))
    pick = lambda g: F.coalesce(F.nullif(a(g), F.lit("")), F.nullif(b(g), F.lit(""))).try_cast("int")
    return F.struct(pick(1).alias("number"), pick(2).alias("year"))


def natural_order(c) -> list[Column]:
    """Sort keys for 1, 2, 12, 12A, 13; what doesn't start with a number comes last."""
    n = F.nullif(F.regexp_extract(col(c), r"^(\d+)", 1), F.lit("")).try_cast("long")
    return [n.isNull(), n, F.regexp_replace(col(c), r"^\d+", "")]


#: Fixed value: what announces a ruling.
CUE = (
    r"(?i)((?:we|I)\s+(?:hold|am of (?:the )?view|are of (?:the )?view|am inclined|therefore hold)|\bheld\s+that|it (?:is|was) (?:hereby )?(?:held|ordered|declared)|"
    r"the appeal is (?:allowed|dismissed)|(?:we|I) (?:set aside|affirm|allow|dismiss)|in (?:my|our) (?:view|opinion|judgment)|the (?:learned )?(?:trial |district )?judge (?:erred|was (?:right|wrong)))"
)


def cue_window(text: Column, head: int = 2400, tail: int = 7200, most: int = 16000, cue: str = CUE) -> Column:
    """Head, cue paragraphs between until they fill what is left of `most` characters, and tail; a text of at most `most` characters is itself."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    gap = "\n\n[...]\n\n"

    def window(t: Column) -> Column:
        between = F.substring(t, F.lit(head + 1), F.length(t) - head - tail)
        cues = F.filter(F.transform(F.split(between, r"(?U)\n\s*\n"), bare), lambda p: (p != "") & F.regexp_like(p, F.lit("(?U)" + cue)))
        start = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(most - head - tail).alias("left"))
        more = lambda a, p: F.when(a["left"] > 0, F.struct(F.concat(a["kept"], F.array(p)).alias("kept"), (a["left"] - F.length(p)).alias("left"))).otherwise(a)
        kept = F.aggregate(cues, start, more, lambda a: a["kept"])
        middle = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit(gap), F.array_join(k, "\n\n"))).otherwise(""))
        whole = F.concat(F.substring(t, 1, head), middle, F.lit(gap), F.right(t, F.lit(tail)))
        return F.when(F.length(t) <= most, t).otherwise(F.substring(whole, 1, most + 2000))

    return let(bare(text), window)


def platform_norm(c) -> Column:
    """NFC is left to the writer; white space squeezed, lower case, thousands' commas and the marks after sums dropped, spaces and points trimmed."""
    bare = F.regexp_replace(F.replace(F.lower(squeeze(c)), F.lit(","), F.lit("")), "/[=-]", "")
    return F.btrim(bare, F.lit(" ."))


def strict_norm(c) -> Column:
    return squeeze(c)


def page_tail_stripped(c, least: int = 25) -> Column:
    """Without a page number at the end, if a sentence remains."""
    return let(F.rtrim(F.regexp_replace(col(c), r"\s+\d{1,4}\s*$", "")), lambda x: F.when(F.length(x) >= least, x).otherwise(col(c)))


def citation_format(c) -> Column:
    """The class of a citation: the first pattern that matches, long text, or other."""
    c = F.coalesce(col(c), F.lit(""))
    kinds = (("Ordinance-No-of-year", r"(?i)Ordinance\s+No\.?\s*\d+\s+of\s+\d{4}"), ("section-of-Act", r"(?i)\bsections?\b.{0,6}\bof the\b"), ("Code-comma-s", r"(?i),\s*s\.?\s*\d"))
    out = F.when(c == "", "empty")
    for name, pattern in kinds:
        out = out.when(F.regexp_like(c, F.lit(pattern)), name)
    return out.when(F.length(c) > 200, "inline-fulltext (long)").otherwise("other")


MARKER = r"\[(\w+),\s*(\d+\s+of\s+\d{4})\]"


def split_markers(c) -> Column:
    """(heading, markers (section, act)) of "Title [50, 79 of 1980]"."""
    found = F.arrays_zip(F.regexp_extract_all(col(c), F.lit(MARKER), F.lit(1)).alias("section"), F.regexp_extract_all(col(c), F.lit(MARKER), F.lit(2)).alias("act"))
    return F.struct(F.btrim(squeeze(F.regexp_replace(col(c), MARKER, "")), F.lit(" .,;:-–—")).alias("heading"), found.alias("markers"))


def file_stem(c) -> Column:
    """number-year-slug by the last number and year in a file's name; null without one."""
    pairs = r"(\d{1,3})[ _-]+(?:of[ _-]+)?(\d{4})"
    last = lambda g: F.try_element_at(F.regexp_extract_all(col(c), F.lit(pairs), F.lit(g)), F.lit(-1))
    rest = F.btrim(F.regexp_replace(F.lower(F.regexp_replace(col(c), pairs, "-")), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(last(1).isNotNull() & (rest != ""), F.concat_ws("-", last(1).cast("int").cast("string"), last(2), rest))


#: Months of sessions.
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")


def earliest_session(c) -> Column:
    """YYYY-MM of the earliest "MONTH YYYY" between slashes, or null."""
    months = F.array(*map(F.lit, MONTHS))

    def of(part: Column) -> Column:
        part = F.upper(F.trim(part))
        month = F.array_position(months, F.regexp_extract(part, r"([A-Z]+)\s+(\d{4})", 1))
        return F.when(month > 0, F.concat(F.regexp_extract(part, r"([A-Z]+)\s+(\d{4})", 2), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))

    return F.array_min(F.transform(F.split(col(c), "/"), of))


def validators(c) -> Column:
    """(nic, iso_date, extent, digits): whether the text has the form of an identity number, a date, an area, a number."""
    c = F.trim(col(c))
    like = lambda p: F.regexp_like(c, F.lit(p))
    return F.struct(like(r"^([0-9]{9}[VXvx]|[0-9]{12})$").alias("nic"), like(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("iso_date"), (like("[0-9]") & like(r"(?i)\b(ha|hectare|hectares)\b")).alias("extent"), like("^[0-9]+$").alias("digits"))


def quoted_items(c) -> Column:
    """The quoted items of a list literal, whichever quotes it has, even if its end is cut off."""
    return F.transform(F.regexp_extract_all(col(c), F.lit("""("[^"]*"|'[^']*')"""), F.lit(1)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
