"""Text, HTML and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import html as H
from tessella.plans.base import Tables, query

NORM = "trim(regexp_replace(translate({}, '‘’‚“”„–—−' || chr(160), '''''''\"\"\"--- '), '\\s+', ' ', 'g'))"


@query("""with c as (select doc_id, unnest(range(0, length(text), 1500)) s, text from documents where length(text) > 0)
select doc_id, (s / 1500)::bigint k, length(substr(text, s + 1, 1800))::bigint n, sha256(substr(text, s + 1, 1800)) h from c where (s = 0 or length(substr(text, s + 1, 1800)) >= 200) and s / 1500 < 16""")
def chunk_overlap(t: Tables):
    """Overlapping chunks as the retrieval unit; 16 a document is the operator's own parameter."""
    rows = t.documents.select("doc_id", F.explode(T.chunks("text")).alias("c"))
    return rows.select("doc_id", F.col("c.k").cast("long").alias("k"), F.length("c.chunk").cast("long").alias("n"), F.sha2("c.chunk", 256).alias("h"))


@query("""with s as (select conv_id, turn, trim(unnest(regexp_extract_all(text, '[^.!?]+[.!?]?'))) s from conversations) select conv_id, turn, count(*) n, max(length(s))::bigint longest from s where s <> '' group by all""")
def split_sentences(t: Tables):
    s = t.conversations.select("conv_id", "turn", F.explode(T.sentences("text")).alias("s"))
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query("""with w as (select doc_id, text, strpos(text, ' the ') p from documents)
select doc_id, case when p > 0 then length(substr(text, p + 5, 1500)) else 0 end::bigint n, case when p = 0 then 'none' when strpos(substr(text, p + 5, 2500), chr(10)) > 0 then 'cut' else 'open' end how from w""")
def headnote(t: Tables):
    """What follows a marker, up to an end marker where there is one."""
    at = F.instr("text", " the ")
    tail = F.substring(F.col("text"), at + 5, F.lit(2500))
    how = F.when(at == 0, "none").when(F.instr(tail, "\n") > 0, "cut").otherwise("open")
    return t.documents.select("doc_id", F.when(at > 0, F.length(F.substring(F.col("text"), at + 5, F.lit(1500)))).otherwise(0).cast("long").alias("n"), how.alias("how"))


@query()
def cue_window(t: Tables):
    """Head, cue paragraphs in budget and tail at the operator's sizes; tests hold it against a plain version."""
    w = t.documents.select("doc_id", T.cue_window(F.col("text")).alias("w"))
    return w.select("doc_id", F.length("w").cast("long").alias("n"), F.md5("w").alias("h"))


@query("""with w as (select doc_id, text, substr(text, 101, 60) q, regexp_extract(substr(text, 101, 60), '[A-Za-z]+') c, strpos(text, substr(text, 101, 60)) p from documents),
v as (select *, substr(text, greatest(p - 40, 1), length(q) + 80) win from w)
select doc_id, case when p > 0 and q <> '' and c <> '' and contains(win, c) then 'window-citation-masked' when p > 0 and q <> '' then 'window-quote-masked' else 'held-sentence-fallback' end how,
trim(regexp_replace(case when p > 0 and q <> '' and c <> '' and contains(win, c) then replace(win, c, ' ') when p > 0 and q <> '' then replace(win, q, ' ') else substr(text, 1, 80) end, '\\s+', ' ', 'g')) query from v""")
def mask_window(t: Tables):
    q = F.substring("text", 101, 60)
    got = T.masked_window(F.col("text"), q, F.regexp_extract(q, "[A-Za-z]+", 0), 40)
    return t.documents.select("doc_id", got.alias("m")).select("doc_id", F.col("m.how").alias("how"), F.col("m.query").alias("query"))


@query("""with g as (select doc_id, item_id from documents d, benchmark b where length(b.text) >= 15 and contains(d.text, b.text)) select item_id, count(distinct doc_id) n, coalesce(min(doc_id), -1) first from benchmark left join g using (item_id) group by item_id""")
def grounding_verbatim(t: Tables):
    """Documents that hold a passage verbatim: candidates share the passage's first 8-word shingle, then containment is tested."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, 3))))
    # The first and last word may be cut inside a document's word, so the key is taken from the second word on.
    items = t.benchmark.where(F.length("text") >= 15).select("item_id", F.col("text").alias("passage"), F.xxhash64(F.slice(words(F.col("text")), 2, 3)).alias("g"))
    docs = t.documents.select("doc_id", "text", F.explode(T.let(words(F.col("text")), grams)).alias("g"))
    hits = docs.join(items, "g").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id").distinct()
    out = hits.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return t.benchmark.select("item_id").join(out, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first", F.lit(-1)).alias("first"))


@query("""with h as (select doc_id, list_intersect(['the', 'and', 'that', 'with', 'from'], regexp_extract_all(lower(text), '[a-z0-9]+')) l, list_intersect(['license', 'copyright'], regexp_extract_all(lower(text), '[a-z0-9]+')) s from documents)
select doc_id, len(s) strong, len(l) lex, 3 * len(s) + len(l) score, len(s) >= 1 or len(l) >= 3 passed from h""")
def gate_lexicon(t: Tables):
    g = T.gate("text", ("license", "copyright"), ("the", "and", "that", "with", "from"))
    return t.documents.select("doc_id", g.alias("g")).select("doc_id", *[F.col(f"g.{c}").alias(c) for c in ("strong", "lex", "score", "passed")])


@query("""with w as (select lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w from documents) select lang, count_if(w = 'the') the_n, count_if(w = 'der') der_n, count_if(w = 'que') que_n from w group by lang""")
def keyword_matrix(t: Tables):
    n = lambda w: F.sum(F.size(F.filter(T.tokens("text"), lambda x: x == w))).alias(f"{w}_n")
    return t.documents.groupBy("lang").agg(n("the"), n("der"), n("que"))


@query("""with s as (select doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) a, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) o from documents)
select doc_id, case when a + o = 0 then 'none' when o / greatest(a + o, 1) >= 0.85 then 'extended' when o / greatest(a + o, 1) >= 0.15 then 'mixed' else 'latin' end script from s""")
def script_detect(t: Tables):
    return t.documents.select("doc_id", T.script_of("text").alias("script"))


@query("""select event_id, case when lower(trim(x)) in ('', 'null', 'none', 'n/a', 'unknown', 'undetected') then null else trim(x) end v from (select event_id, case event_id % 5 when 0 then ' N/A ' when 1 then '' when 2 then 'Unknown' else event_type || ' ' end x from events)""")
def null_collapse(t: Tables):
    k = F.col("event_id") % 5
    x = F.when(k == 0, " N/A ").when(k == 1, "").when(k == 2, "Unknown").otherwise(F.concat("event_type", F.lit(" ")))
    return t.events.select("event_id", T.null_collapse(x).alias("v"))


@query("""select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '&', ' and ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug from part""")
def slugify(t: Tables):
    return t.part.select("p_partkey", T.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"))


@query("""select p_partkey, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(p_name || ' of the ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ('of', 'the', 'a', 'an', 'and', 'in', 'on', 'to', 'for', 'with')), lambda w: substr(w, 1, 1)), '') acronym from part""")
def acronym(t: Tables):
    return t.part.select("p_partkey", T.acronym(F.concat("p_name", F.lit(" of the "), "p_type")).alias("acronym"))


@query("""select p_partkey, regexp_replace(regexp_replace(trim(regexp_replace(lower('The ' || p_name || ' Act'), '[^a-z0-9]+', ' ', 'g')), '^the ', ''), ' (act|ordinance|law)$', '') title, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' Ordinance (Amendment) Act'), '\\s*\\(amendment.*$', ''), '\\b(ordinance|act|law)\\b.*$', ''), '[^a-z0-9]+', ' ', 'g')) stem from part""")
def title_keys(t: Tables):
    return t.part.select("p_partkey", T.normal_title(F.concat(F.lit("The "), "p_name", F.lit(" Act"))).alias("title"), T.title_stem(F.concat("p_name", F.lit(" Ordinance (Amendment) Act"))).alias("stem"))


@query("""with s as (select l_orderkey, 'see section ' || l_partkey % 50 || case when l_linenumber = 1 then 'A' else '' end || ' and sections ' || l_suppkey % 9 txt from lineitem)
select l_orderkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(txt, '(?i)\\bsections?\\s+(\\d{1,4}[A-Z]?)\\b', 1), lambda x: upper(x)))), ',') refs, count(*) n from s group by all""")
def section_xrefs(t: Tables):
    """Section references, extracted again from synthesised text."""
    return _xrefs(t.lineitem)


def _xrefs(lines):
    s = lines.select("l_orderkey", F.concat(F.lit("see section "), (F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_linenumber") == 1, "A").otherwise(""), F.lit(" and sections "), (F.col("l_suppkey") % 9).cast("string")).alias("txt"))
    refs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("txt", F.lit(r"(?i)\bsections?\s+(\d{1,4}[A-Z]?)\b"), F.lit(1)), lambda x: F.upper(x))))
    return s.groupBy("l_orderkey", F.array_join(refs, ",").alias("refs")).agg(F.count("*").alias("n"))


@query("""with b as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') x from pages)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) text from b""")
def html_strip(t: Tables):
    return t.pages.select("page_id", T.strip_html("html").alias("text"))


@query("""select page_id, len(regexp_extract_all(html, '<p[ >]')) n_p, len(regexp_extract_all(html, '<a[ >]')) n_a, len(regexp_extract_all(html, '<b>')) n_b, len(regexp_extract_all(html, '<br')) n_br, regexp_matches(html, '<article') has_article, regexp_matches(html, '</html>') closed, round(len(regexp_extract_all(html, '<a[ >]')) / greatest(len(regexp_extract_all(html, '<p[ >]')), 1), 6) ratio from pages""")
def layout_fingerprint(t: Tables):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return t.pages.select("page_id", n("<p[ >]").alias("n_p"), n("<a[ >]").alias("n_a"), n("<b>").alias("n_b"), n("<br").alias("n_br"), F.contains("html", F.lit("<article")).alias("has_article"), F.contains("html", F.lit("</html>")).alias("closed"), F.round(n("<a[ >]") / F.greatest(n("<p[ >]"), F.lit(1)), 6).alias("ratio"))


@query("""with s as (select page_id, 1 / (1 + exp(-(len(regexp_extract_all(html, '<p[ >]')) - 8) / 4.0::double)) long, 1 / (1 + exp(-(len(regexp_extract_all(html, '<a[ >]')) - 6) / 2.0::double)) links from pages)
select page_id, case when greatest(long, links) < 0.75 or abs(long - links) < 0.2 then 'uncertain' when long > links then 'long' else 'links' end bucket from s""")
def layout_bucket(t: Tables):
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    s = t.pages.select("page_id", sigmoid((F.regexp_count("html", F.lit("<p[ >]")) - 8) / 4.0).alias("long"), sigmoid((F.regexp_count("html", F.lit("<a[ >]")) - 6) / 2.0).alias("links"))
    return s.select("page_id", F.when((F.greatest("long", "links") < 0.75) | (F.abs(F.col("long") - F.col("links")) < 0.2), "uncertain").when(F.col("long") > F.col("links"), "long").otherwise("links").alias("bucket"))


@query("""select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) path, regexp_extract(url, '[?&]page=([^&#]*)', 1) page, regexp_extract(url, '#(.*)$', 1) frag from pages""")
def url_parts(t: Tables):
    part = lambda k, *more: F.coalesce(F.parse_url("url", F.lit(k), *map(F.lit, more)), F.lit(""))
    return t.pages.select("page_id", part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY", "page").alias("page"), part("REF").alias("frag"))


@query()
def html_blocks(t: Tables):
    """Blocks between a page's heading and its footer, with bold shares; one Arrow pass."""
    return H.segments(t.pages, "page_id", "html", start="h1", stop=("footer",))


@query("""with a as (select item_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') t from benchmark) select item_id, levenshtein(t, substr(t, 1, greatest(length(t) - 10, 0))) d, round(levenshtein(t, substr(t, 1, greatest(length(t) - 10, 0))) / length(t), 6) cer from a where length(t) > 0""")
def edit_rates(t: Tables):
    """Character error rate of a copy without its last ten characters, over whole texts."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    cut = F.substring(plain, F.lit(1), F.greatest(F.length(plain) - 10, F.lit(0)))
    return t.benchmark.where(F.length(plain) > 0).select("item_id", F.levenshtein(plain, cut).alias("d"), F.round(F.levenshtein(plain, cut) / F.length(plain), 6).alias("cer"))


@query(f"""select item_id, {NORM.format("text || chr(10) || '‘x’ — ' || chr(160) || 'y'")} norm from benchmark""")
def normalize_text(t: Tables):
    return t.benchmark.select("item_id", T.normalize(F.concat("text", F.lit("\n‘x’ —  y"))).alias("norm"))
