"""Queries over the corpus tables and their SQL, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that leaves one table, its result: those it needs on the way are deleted once that is written."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settled(spark, query.__name__, lambda: query(spark, sf_dir))

    return run


@tidy
def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import near_duplicate_passages

    return near_duplicate_passages(_table(spark, sf_dir, "documents"))


@tidy
def op3_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, train_from_documents

    docs = _table(spark, sf_dir, "documents")
    return find_secrets(docs, train_from_documents(docs))


def _held_out(doc_id: str, folds: int, held: int):
    return F.coalesce(crc_bucket(F.col(doc_id), folds) == held, F.lit(False))


def op4_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import TOXIC_FROM, score_documents, train_from_labels

    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, train_from_labels(docs, _table(spark, sf_dir, "labels"), held=2))
    return scored.select("doc_id", _held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op5_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train_from_documents

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, train_from_documents(docs))
    return found.select("doc_id", _held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")


@tidy
def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_digits, near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@tidy
def op7_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    mixed = mix_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@tidy
def op9_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, joined

    found = find_personal_data(_table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s.getField("kind") == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def op10_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"))


def op11_pruned_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))


def op12_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(_table(spark, sf_dir, "documents"))


def op13_term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_compact_windows": op2_compact_windows,
    "op3_char_cnn_secrets": op3_char_cnn_secrets,
    "op4_zstd_toxicity": op4_zstd_toxicity,
    "op5_kneser_ney_langid": op5_kneser_ney_langid,
    "op6_simhash_bktree": op6_simhash_bktree,
    "op7_pivot_permutations": op7_pivot_permutations,
    "op8_entropy_mix": op8_entropy_mix,
    "op9_disclosing_terms": op9_disclosing_terms,
    "op10_prefix_table_pieces": op10_prefix_table_pieces,
    "op11_pruned_graphs": op11_pruned_graphs,
    "op12_event_sweep": op12_event_sweep,
    "op13_term_dictionary": op13_term_dictionary,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_frequency": r"""
        with d as (select doc_id, source, coalesce(text, '') as text from documents),
        w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
        win as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from
            (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w))),
        rep as (select doc_id, count(distinct p)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from win where n > 1) group by 1),
        dup as (select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
            where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
        line as (select distinct doc_id, source, trim(line) as line from (select doc_id, source,
            unnest(string_split(lower(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')), chr(10))) as line from d) where trim(line) <> ''),
        shared as (select source, line from line group by 1, 2 having count(distinct doc_id) > 20),
        total as (select doc_id, sum(length(line))::bigint as total from line group by 1),
        gone as (select doc_id, sum(length(l.line))::bigint as removed from line l join shared s on s.line = l.line and s.source is not distinct from l.source group by 1),
        base as (select d.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]'))::bigint as n_symbols,
            coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(total, 0) as total, coalesce(removed, 0)::bigint as removed_chars
            from d join w using (doc_id) left join dup using (doc_id) left join rep using (doc_id) left join total using (doc_id) left join gone using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
            not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and total - removed_chars >= total * 0.5 as kept, removed_chars from base""",
    "op7_pivot_permutations": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
            and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
            where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
        reach as (select vec_id as a, vec_id as r from embeddings union select link.b, reach.r from reach join link on link.a = reach.a)
        select vec_id, (select count(*) from link where a = vec_id) as n_links, least_id as component_id, vec_id = least_id as kept
            from embeddings join (select a, min(r) as least_id from reach group by 1) on a = vec_id""",
    "op9_disclosing_terms": r"""
        with d as (select doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as text, coalesce(text, '') as raw from documents),
        rule as (select * from (values (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
            (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) as t (k, kind, rx)),
        mark as (select doc_id, k, kind, string_split(case k when 0 then regexp_replace(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)', chr(1) || '\1' || chr(2), 'g')
            when 1 then regexp_replace(text, '([0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+))', chr(1) || '\1' || chr(2), 'g')
            when 2 then regexp_replace(text, '([0-9]([\x20-]?[0-9])+)', chr(1) || '\1' || chr(2), 'g')
            else regexp_replace(text, '(\+[0-9][\x20().0-9-]+[0-9])', chr(1) || '\1' || chr(2), 'g') end, chr(1)) as p from d, rule),
        piece as (select doc_id, k, kind, unnest(p) as piece, generate_subscripts(p, 1) as i from mark where len(p) > 1),
        found as (select doc_id, k, kind, i, split_part(piece, chr(2), 1) as value, coalesce(sum(length(piece) - (i > 1)::int) over (partition by doc_id, k order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s from piece),
        span as (select doc_id, k, kind, value, s, s + length(value) as e, regexp_replace(value, '[^0-9]', '', 'g') as g from found where i > 1),
        ok as (select * from span where k = 0
            or (k = 1 and len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as int), 0) > 255)) = 0)
            or (k = 2 and length(g) between 14 and 19 and list_sum(list_transform(range(0, length(g)), lambda i: case when i % 2 = 0 then g[length(g) - i]::int when g[length(g) - i]::int > 4 then g[length(g) - i]::int * 2 - 9 else g[length(g) - i]::int * 2 end)) % 10 = 0)
            or (k = 3 and length(g) between 10 and 15)),
        ctx as (select distinct doc_id, lower(value) as entity, lower(case when s > 160 then regexp_replace(substr(raw, s - 159, 160), '^\S+', '') else substr(raw, 1, s) end || chr(10) || case when e + 160 < length(raw) then regexp_replace(substr(raw, e + 1, 160), '\S+\z', '') else substr(raw, e + 1, 160) end) as context from ok join d using (doc_id)),
        often as (select entity, count(distinct doc_id) as n_c from ctx group by 1 having count(distinct context) >= 3),
        word as (select doc_id, entity, context, unnest(list_distinct(regexp_extract_all(context, '[\p{L}][\p{L}\p{N}''-]+'))) as term from ctx),
        pair as (select entity, term, n_c, count(distinct doc_id) as n_ct from word join often using (entity) group by 1, 2, 3 having count(distinct context) >= 3),
        corpus as (select unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}][\p{L}\p{N}''-]+'))) as term from documents),
        known as (select term, count(*) as n_t from corpus where term in (select term from pair) group by 1),
        least as (select term, count(distinct doc_id) as least_t from word group by 1),
        flagged as (select entity, term from pair join known using (term) join least using (term), (select count(*)::double as n from documents) where ln(n_ct * n / (n_c * greatest(n_t, least_t))) >= 0.8 * ln(n / n_c)),
        asked as (select distinct doc_id, term from (select distinct doc_id, lower(value) as entity from ok) join flagged using (entity)),
        run as (select doc_id, string_split(regexp_replace(text, '([\p{L}\p{N}''-]+)', chr(1) || '\1' || chr(2), 'g'), chr(1)) as p from d where doc_id in (select doc_id from asked)),
        token as (select doc_id, split_part(piece, chr(2), 1) as value, i, coalesce(sum(length(piece) - (i > 1)::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s from (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as i from run)),
        term as (select t.doc_id, t.s, t.s + length(value) as e from token t join asked a on a.doc_id = t.doc_id and a.term = lower(t.value) where i > 1
            and not exists (select 1 from ok where ok.doc_id = t.doc_id and ok.s < t.s + length(t.value) and t.s < ok.e)),
        base as (select doc_id, count(*) filter (where k = 0) as n_email, count(*) filter (where k = 1) as n_ip, count(*) filter (where k = 2) as n_card, count(*) filter (where k = 3) as n_phone,
            string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from ok group by 1),
        every as (select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from (select doc_id, k, kind, s, e from ok union all select doc_id, 4, 'term', s, e from term) group by 1)
        select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base.spans, '')) as base_sha256, coalesce(every.spans, '') as spans
            from documents left join base using (doc_id) left join every using (doc_id)""",
    # The nearest by brute force: on small tables a shard's search finds all of them.
    "op11_pruned_graphs": """
        with v as (select distinct vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
            and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        far as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda a, b: a + b)) as score
            from v q join v c on len(q.e) = len(c.e) and q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
        near as (select query_id, vec_id, min(score) as score from far group by 1, 2)
        select query_id, rank, vec_id, score from (select query_id, (row_number() over (partition by query_id order by score, vec_id))::int as rank, vec_id, score from near) where rank <= 10""",
    "op13_term_dictionary": r"""
        with d as (select row_number() over () as r, coalesce(text,'') as text, coalesce(lang,'') as lang, coalesce(source,'') as source from documents),
        word as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
        kept as (select lang, term from word group by 1, 2 having count(distinct r) >= 3),
        grp as (select distinct lang, source from d),
        cnt as (select lang, source, term, count(*)::hugeint as n from word semi join kept using (lang, term) group by 1, 2, 3),
        size as (select lang, (select count(*) from kept where kept.lang = l.lang)::hugeint as v from (select distinct lang from d) l),
        total as (select lang, source, coalesce(sum(n), 0)::hugeint as total from grp left join cnt using (lang, source) group by 1, 2),
        p as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (total + v) as p from total join size using (lang) join kept using (lang) left join cnt using (lang, source, term)),
        q as (select lang, term, 1 + (1000000000 * (sum(n) + 1)) // (max(t) + max(v)) as q from p join (select lang, sum(total)::hugeint as t from total group by 1) using (lang) join size using (lang) group by 1, 2),
        pair as (select a.lang, a.source, b.source as item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        pairs as (select g.lang, g.source, h.source as item, coalesce(value, 0)::bigint as value from grp g join grp h on g.lang = h.lang and g.source <> h.source left join pair on pair.lang = g.lang and pair.source = g.source and pair.item = h.source),
        terms as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p join q using (lang, term) where n > 0 and p > q)
        select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
        union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200""",
}
