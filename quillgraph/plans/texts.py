"""Text queries over documents and pages, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text as T
from ..operators import canonical, explore, extraction, silver
from ..operators.explore import NOISE, PUNCTUATION, THEMES
from .adapters import table
from .config import DEFAULT

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TOKEN = T.TOKEN.replace("'", "''")
WORDS = f"words as (select doc_id, lang, text, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') w from documents)"
LONG = f"with {WORDS}, long as (select doc_id, lang, unnest(w) word from words)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


_LINES = "lines as (select doc_id, coalesce(text, '') t, trim(split_part(coalesce(text, ''), chr(10), 1)) title, trim(substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2)) body from documents)"


def _titled(spark, d):
    text = F.coalesce("text", F.lit(""))
    first = F.split(text, "\n")[0]
    return docs(spark, d).select("doc_id", F.trim(first).alias("title"), F.trim(F.substring(text, F.length(first) + 2, F.length(text))).alias("body"))


@query(f"""with {_LINES}, told as (select *, lower(title) = lower(body) or starts_with(lower(body), regexp_replace(lower(title), '[.…\\s]+$', '')) or len(list_filter(list_distinct(regexp_extract_all(lower(title), '{TOKEN}')), lambda x: not list_contains(regexp_extract_all(lower(body), '{TOKEN}'), x))) = 0 known from lines)
select doc_id, case when title = '' then body when body = '' then title when known then body else title || chr(10) || body end as text, title <> '' and (body = '' or not known) kept from told""")
def f05_merged_titles(spark, d):
    merged = T.merge_title(F.col("title"), F.col("body"))
    return _titled(spark, d).select("doc_id", merged.alias("m")).select("doc_id", "m.text", "m.kept")


_TRUNCATED = """with c as (select doc_id, coalesce(text, '') t, substr(coalesce(text, ''), 1, 1500) s from documents)
select doc_id, case when length(t) <= 1500 then t else regexp_replace(case when contains(s, ' ') then regexp_replace(s, ' [^ ]*$', '', 's') else s end, '[ ,;:-]+$', '') || ' [...]' end as text from c"""


@query(_TRUNCATED)
def f06_truncated(spark, d):
    return docs(spark, d).select("doc_id", T.truncate_text(F.coalesce("text", F.lit("")), DEFAULT.max_review_chars).alias("text"))


@query(f"with {WORDS} select doc_id, len(w) n_words, len(w) < 4 is_low_content from words")
def f08_word_counts(spark, d):
    n = T.n_words(F.lower(F.coalesce("text", F.lit(""))))
    return docs(spark, d).select("doc_id", n.cast("long").alias("n_words"), (n < 4).alias("is_low_content"))


_SING = "case when word in (" + ", ".join(f"'{w}'" for w in names.SINGULAR) + ") or length(word) <= 3 then word when word like '%ies' and length(word) > 4 then left(word, -3) || 'y' when regexp_matches(word, '(ss|sh|ch|x)es$') then left(word, -2) when word like '%s' and not regexp_matches(word, '[suio]s$') then left(word, -1) else word end"


@query(LONG + f" select word, {_SING} singular, count(*) n from long group by all")
def f10_singulars(spark, d):
    return explore.words_of(docs(spark, d)).groupBy("word", names.singular(F.col("word")).alias("singular")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, 'e_' || trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') entity_id from part")
def f11_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", names.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("entity_id"))


@query("select doc_id, doc_id || '|v2|offline' as key, sha256(coalesce(text, '')) digest from documents")
def f14_cache_keys(spark, d):
    return docs(spark, d).select("doc_id", extraction.cache_key(F.col("doc_id"), DEFAULT.prompt_version, "offline").alias("key"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') escaped from pages")
def f16_html_escaped(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query(None)
def f02_unescaped_titles(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_text(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@query(None)
def f09_name_traces(spark, d):
    part = table(spark, d, "part").select("p_name").distinct()
    return part.select("p_name", names.normalize_trace(F.initcap(F.concat(F.lit("The "), "p_name", F.lit("s"))), DEFAULT.brand).alias("trace")).select("p_name", F.element_at("trace", -1)["result"].alias("name"), F.array_join(names.changed_steps(F.col("trace")), ", ").alias("changed"))


@query(None)
def x01_silver(spark, d):
    return silver.reviews_clean(docs(spark, d).select(F.col("doc_id").cast("string").alias("review_id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("text"), "source", F.col("lang").alias("language")), DEFAULT)


@query(f"select doc_id, 'language: ' || coalesce(lang, '') || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || chr(10) || t.text message from documents join ({_TRUNCATED}) t using (doc_id)")
def x04_messages(spark, d):
    return docs(spark, d).select("doc_id", extraction.message({"language": F.col("lang"), "source": F.col("source")}, F.coalesce("text", F.lit("")), DEFAULT.max_review_chars).alias("message"))


@query(None)
def x05_extractions(spark, d):
    return extraction.offline(docs(spark, d).select("doc_id", "text"), DEFAULT).select("doc_id", F.to_json("extraction").alias("extraction"))


@query("select d.doc_id from documents d where d.doc_id not in (select doc_id from labels)")
def x07_uncached(spark, d):
    return extraction.missing(docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query(None)
def x09_canonical_names(spark, d):
    counted = explore.words_of(docs(spark, d)).groupBy(F.col("word").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("category", F.lit("other"))
    return canonical.canonical_map(counted, DEFAULT.fuzzy_threshold)


@query("with a as (select split_part(p_name, ' ', 1) raw, p_partkey id, 'first' as role from part union all select upper(split_part(p_name, ' ', 2)), p_partkey, 'second' from part) select raw, lower(raw) normalized, count(*) n_mentions, count(distinct id) n_reviews, array_to_string(list_sort(list_distinct(list(role))), ',') roles, min(id) example_review_id from a group by raw")
def x10_lineage(spark, d):
    part = table(spark, d, "part")
    w = F.split("p_name", " ")
    used = part.select(w[0].alias("raw"), F.col("p_partkey").alias("review_id"), F.lit("first").alias("role")).unionByName(part.select(F.upper(w[1]), "p_partkey", F.lit("second")).toDF("raw", "review_id", "role"))
    return canonical.lineage(used, F.lower("raw")).withColumn("roles", F.array_join("roles", ","))


@query("select count(*) n, count(*) - count(distinct text) repeated, count(*) filter (text is null) null_texts, count(*) filter (text like '%&%;%') entities, count(*) filter (n_chars not between 1 and 100000) out_of_range from documents")
def n01_quality(spark, d):
    x = docs(spark, d)
    return x.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("text")).alias("repeated"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.count_if(F.col("text").like("%&%;%")).alias("entities"), F.count_if(~F.col("n_chars").between(1, 100000)).alias("out_of_range"))


@query("select lang, count(*) n, quantile_cont(n_chars, 0.5) median, cast(max(n_chars) as bigint) longest, round(avg(n_chars), 6) mean from documents group by lang")
def n05_lengths_by_language(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("median"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query(f"with {WORDS} select cast(least(len(w) // 5 * 5, 150) as bigint) bin, count(*) n from words group by all")
def n09_length_histogram(spark, d):
    n = F.size(explore.lower_words(F.col("text")))
    return docs(spark, d).groupBy(F.least(F.floor(n / 5) * 5, F.lit(150)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _patterns_sql(patterns: dict[str, str], group: str, condition: str = "'i'") -> str:
    rows = ", ".join("('{}', '{}')".format(n, p.replace("'", "''")) for n, p in patterns.items())
    return f"with p(pattern, expr) as (values {rows}) select pattern, {group} grp, count(*) filter (regexp_matches(coalesce(text, ''), expr, {condition})) n, round(avg(case when regexp_matches(coalesce(text, ''), expr, {condition}) then 1.0 else 0.0 end), 6) share from documents, p group by all"


def _patterns(name: str, patterns: dict[str, str], column: str, sql_patterns: dict[str, str] | None = None):
    """A query of the share of texts that match each pattern, by a column."""

    def run(spark, d):
        return explore.shares_of(docs(spark, d), patterns, F.col(column)).withColumn("share", F.round("share", 6))

    run.__name__ = name
    QUERIES[name] = run
    rows = " union all ".join("select '{0}' as pattern, {1} grp, count(*) filter (regexp_matches(coalesce(text, ''), '(?i){2}')) n, round(avg(case when regexp_matches(coalesce(text, ''), '(?i){2}') then 1.0 else 0.0 end), 6) share from documents group by {1}".format(n, column, p.replace("'", "''")) for n, p in (sql_patterns or patterns).items())
    ORACLE_SQL[name] = rows


_patterns("n10_themes", THEMES, "lang")
_patterns("n12_misdirected", {"misdirected": r"(?:^|[^\p{L}])(?:order|delivery|refund|der)(?:[^\p{L}]|$)"}, "lang")
_patterns("n15_invisible", {"double_space": "  ", "tab": "\t", "soft_hyphen": "­", "mojibake": "Ã|â€"}, "source")
_patterns("n22_punctuation", PUNCTUATION, "lang")
_patterns("n25_noise", NOISE, "lang")
_patterns("n31_concepts", {"and": r"(?:^|[^\p{L}])(?:and|und|et|y)(?:[^\p{L}]|$)", "the": r"(?:^|[^\p{L}])(?:the|der|die|le|la|el)(?:[^\p{L}]|$)", "that": r"(?:^|[^\p{L}])(?:that|que|dass)(?:[^\p{L}]|$)"}, "lang")
_patterns("n32_negation", {"negated": r"(?:^|[^\p{L}])(?:not|nicht|pas|no)(?: [a-z]+){0,2} (?:the|der|la|de)(?:[^\p{L}]|$)"}, "lang")


@query(LONG + ", held as (select word, count(distinct doc_id) filter (lang = 'en') a, count(distinct doc_id) filter (lang <> 'en') b from long group by word), odds as (select word, a, b, ln((a + 0.5) / ((select count(*) from documents where lang = 'en') + 1)) - ln((b + 0.5) / ((select count(*) from documents where lang <> 'en') + 1)) log_odds from held where a + b >= 10) select word, a, b, round(log_odds, 6) log_odds, 'top' as end from (select * from odds order by round(log_odds, 9) desc, word limit 15) union all select word, a, b, round(log_odds, 6), 'bottom' from (select * from odds order by round(log_odds, 9), word limit 15)")
def n11_distinctive_terms(spark, d):
    return explore.distinctive(docs(spark, d), F.col("lang") == "en").withColumn("log_odds", F.round("log_odds", 6))


@query(f"with {WORDS} select g bigram, count(*) n from (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from words) group by g having count(*) >= 5")
def w10_bigrams(spark, d):
    return explore.bigrams(docs(spark, d))


@query(f"select lower(raw) word, count(distinct raw) forms, count(*) n from (select unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) raw from documents) group by 1 having count(distinct raw) >= 3")
def n20_case_forms(spark, d):
    return explore.case_forms(docs(spark, d))


@query(LONG + " select word, count(distinct doc_id) n, count(distinct doc_id) / cast((select count(*) from documents) as double) share from long group by word having count(distinct doc_id) / cast((select count(*) from documents) as double) >= 0.02")
def n30_document_frequency(spark, d):
    return explore.document_frequency(docs(spark, d))


@query(LONG + ", c as (select word, count(*) n from long where length(word) >= 5 and regexp_matches(word, '^[a-z]+$') group by word) , f as (select word, n, unnest(list_distinct([word] || list_transform(range(1, length(word) + 1), lambda k: left(word, k - 1) || substr(word, k + 1)))) form from c where n <= 2 or n >= 20) select distinct r.word rare_word, o.word frequent_word from f r join f o on r.form = o.form where r.n <= 2 and o.n >= 20 and damerau_levenshtein(r.word, o.word) = 1")
def n27_spelling_candidates(spark, d):
    return explore.spelling_candidates(docs(spark, d))


@query("select lang, count(*) n, count(*) filter (u) shouting, round(avg(case when u then 1.0 else 0.0 end), 6) share from (select lang, len(w) >= 3 and len(list_filter(w, lambda x: x = upper(x))) > 0.5 * len(w) u from (select lang, regexp_extract_all(coalesce(text, ''), '\\p{L}{3,}') w from documents)) group by lang")
def n21_shouting(spark, d):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}{3,}"), 0)
    loud = F.size(F.filter("w", lambda x: x == F.upper(x)))
    marked = docs(spark, d).select("lang", words.alias("w")).select("lang", ((F.size("w") >= 3) & (loud > 0.5 * F.size("w"))).alias("u"))
    return marked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("u").alias("shouting"), F.round(F.avg(F.col("u").cast("double")), 6).alias("share"))


@query("with k as (select lower(trim(coalesce(text, ''))) t, count(*) n from documents group by 1) select count(*) filter (n > 1) repeated_texts, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) in_groups, cast(sum(n - 1) as bigint) beyond_first from k")
def a22_duplicates(spark, d):
    k = docs(spark, d).groupBy(F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return k.agg(F.count_if(F.col("n") > 1).alias("repeated_texts"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_groups"), F.sum(F.col("n") - 1).alias("beyond_first"))


@query("select lang, case when len(w) = 0 then 'none' when len(w) <= 10 then 'short' when len(w) <= 100 then 'medium' else 'long' end bin, count(*) n from (select lang, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}{5,}') w from documents) group by all")
def n33_content_bins(spark, d):
    n = F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{5,}"), 0))
    label = F.when(n == 0, "none").when(n <= 10, "short").when(n <= 100, "medium").otherwise("long")
    return docs(spark, d).groupBy("lang", label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(*) filter (len(regexp_extract_all(coalesce(text, ''), '\\p{Latin}')) >= 0.5 * length(coalesce(text, ''))) latin, count(*) filter (regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]')) beyond_ascii from documents group by lang")
def n18_scripts(spark, d):
    text = F.coalesce("text", F.lit(""))
    return docs(spark, d).groupBy("lang").agg(F.count_if(F.regexp_count(text, F.lit(r"\p{IsLatin}")) >= 0.5 * F.length(text)).alias("latin"), F.count_if(text.rlike(r"[^\x00-\x7F]")).alias("beyond_ascii"))


@query("select entity, count(*) n, count(distinct page_id) pages from (select page_id, unnest(regexp_extract_all(html, '&#?[A-Za-z0-9]+;')) entity from pages) group by entity")
def n13_entity_census(spark, d):
    long = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"&#?[A-Za-z0-9]+;"), 0)).alias("entity"))
    return long.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


@query("select lang, count(*) n, count(*) filter (nfc_normalize(text) <> text) changed from documents group by lang")
def n14_nfc_changes(spark, d):
    same = docs(spark, d).withColumn("same", T.nfc("text") == F.col("text"))
    return same.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("same")).alias("changed"))


@query(f"with {_LINES} select case when title = '' then 'no title' when lower(title) = lower(body) then 'equal' when starts_with(lower(body), lower(title)) then 'prefix' when contains(lower(body), lower(title)) then 'contained' else 'other' end relation, count(*) n from lines group by 1")
def n16_title_relations(spark, d):
    t, b = F.lower("title"), F.lower("body")
    kind = F.when(t == "", "no title").when(t == b, "equal").when(F.startswith(b, t), "prefix").when(F.contains(b, t), "contained").otherwise("other")
    return _titled(spark, d).groupBy(kind.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {WORDS}, m as (select doc_id, len(list_filter(w, lambda x: x in ('the','and','of','that','is'))) en, len(list_filter(w, lambda x: x in ('der','die','und','ist','das'))) de, len(list_filter(w, lambda x: x in ('le','les','des','et','une'))) fr, len(list_filter(w, lambda x: x in ('el','los','que','y','una'))) es, lang from words) select lang, case when greatest(en, de, fr, es) = 0 then 'none' when en = greatest(en, de, fr, es) then 'en' when de = greatest(en, de, fr, es) then 'de' when fr = greatest(en, de, fr, es) then 'fr' else 'es' end detected, count(*) n from m group by all")
def n17_languages(spark, d):
    """Detected by counts of very frequent words, against the label."""
    known = {"en": ("the", "and", "of", "that", "is"), "de": ("der", "die", "und", "ist", "das"), "fr": ("le", "les", "des", "et", "une"), "es": ("el", "los", "que", "y", "una")}
    def held(values):
        return F.size(F.filter("w", lambda x: x.isin(*values)))

    counted = docs(spark, d).select("lang", explore.lower_words(F.col("text")).alias("w")).select("lang", *(held(v).alias(k) for k, v in known.items()))
    most = F.greatest(*known)
    found = F.when(most == 0, "none")
    for k in known:
        found = found.when(F.col(k) == most, k)
    return counted.groupBy("lang", found.alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@query(None)
def n26_accent_collisions(spark, d):
    return explore.accent_collisions(docs(spark, d))


@query(None)
def n28_vocabulary_funnel(spark, d):
    return explore.vocabulary_funnel(docs(spark, d))


@query(LONG + ", s as (select word, regexp_replace(word, '(tion|ung|ment|ing|ed|es|s|er|en|e)$', '') stem from long where length(word) >= 6) select stem, count(distinct word) forms, count(*) n from s where length(stem) >= 4 group by stem having count(distinct word) >= 3")
def n29_inflections(spark, d):
    stem = F.regexp_replace("word", "(tion|ung|ment|ing|ed|es|s|er|en|e)$", "")
    long = explore.words_of(docs(spark, d)).where(F.length("word") >= 6).withColumn("stem", stem).where(F.length("stem") >= 4)
    return long.groupBy("stem").agg(F.countDistinct("word").alias("forms"), F.count(F.lit(1)).alias("n")).where("forms >= 3")


@query("select case when host like '%.org' then 'org' when host like '%.net' then 'net' when host like '%.com' then 'com' else 'other' end domain, count(*) n, count(distinct host) hosts from (select regexp_extract(lower(url), '://([^/?#]*)', 1) host from pages) group by 1")
def n19_domains(spark, d):
    host = F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1)
    kind = F.when(host.like("%.org"), "org").when(host.like("%.net"), "net").when(host.like("%.com"), "com").otherwise("other")
    return table(spark, d, "pages").select(host.alias("host"), kind.alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("hosts"))


@query("select source, count(*) n, count(*) filter (regexp_matches(coalesce(text, ''), '[\\x{1F300}-\\x{1FAFF}]')) with_emoji from documents group by source")
def n24_emoji(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("text", F.lit("")).rlike(r"[\x{1F300}-\x{1FAFF}]")).alias("with_emoji"))


@query(f"select word, count(*) n from (select unnest(regexp_extract_all(replace(lower(coalesce(text, '')), ' of ', ' o'''), '{TOKEN}')) word from documents) where contains(word, '''') group by word")
def n23_contractions(spark, d):
    """The texts hold no apostrophes, so "of" is read as the contraction o' of the next word."""
    spoken = docs(spark, d).withColumn("text", F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit(" of "), F.lit(" o'")))
    return explore.words_of(spoken).where(F.contains("word", F.lit("'"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
