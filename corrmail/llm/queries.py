"""The contract queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, exact, jaccard, linededup, mixing, packing, pages, quality, rans, suffix, toxicity, vectors


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(documents(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(documents(spark, sf_dir))


def op4_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), 50257)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.drop_repeated_lines(documents(spark, sf_dir)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.coded_with_errors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def _codebook_rounds(rounds: int) -> str:
    """CTEs of the rounds: c0, the distances a0, the refined c1, and so on up to the last distances."""
    distance = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    text = ""
    for k in range(rounds + 1):
        text += f"""
        a{k} as (select id, p, min(coalesce({distance}, 0)::hugeint * 64 + c.e) as m from x join c{k} as c using (p) group by id, p),"""
        if k < rounds:
            text += f"""
        s{k} as (select p, m % 64 as e, i, sum(x.v[i])::hugeint as s, count(*)::hugeint as n
                from a{k} join x using (id, p), unnest(range(1, len(x.v) + 1)) as u(i) group by all),
        m{k} as (select p, e, list((s - ((s % n + n) % n)) // n order by i) as v from s{k} group by p, e),
        c{k + 1} as (select c.p, c.e, coalesce(m.v, c.v) as v from c{k} as c left join m{k} as m on m.p = c.p and m.e = c.e),"""
    return text


ORACLES = {
    "op12_vector_codes": f"""
        with e as (select row_number() over (order by vec_id nulls last, embedding) as id, vec_id, label,
                          list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
                   from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        x as (select id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as v from e, unnest(range(0, 16)) as u(p)),
        c0 as (select p, (id - 1)::hugeint as e, v::hugeint[] as v from x where id <= 64),{_codebook_rounds(2)}
        r as (select id, string_agg(printf('%02x', (m % 64)::int), '' order by p) as code, sum(m // 64)::bigint as error from a2 group by id),
        h as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from c2)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
        from r join e using (id), h
    """,
    "op13_source_divergence": r"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        c as (select lang, source, term, count(*) as n, count(distinct r) as docs from w group by all),
        v as (select lang, term, sum(n) as n from c group by all having sum(docs) >= 3),
        l as (select lang, count(*) as v, sum(n) as total from v group by lang),
        t as (select lang, source, sum(c.n) as total from c join v using (lang, term) group by all),
        g as (select lang, source, coalesce(v, 0) as v, coalesce(t.total, 0) as total, coalesce(l.total, 0) as lang_total
              from (select distinct lang, source from d) left join l using (lang) left join t using (lang, source)),
        p as (select g.lang, g.source, v.term, coalesce(c.n, 0) as n,
                     1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + g.v) as p,
                     1 + (1000000000::hugeint * (v.n + 1)) // (g.lang_total + g.v) as q
              from g join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = v.term),
        pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
                 from p as a join p as b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
                 union all
                 select a.lang, a.source, b.source, 0 from g as a join g as b on a.lang = b.lang and a.source <> b.source where a.v = 0),
        part as (select lang, source, 'pair' as part, item, value from pair
                 union all
                 select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from part)
        select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
    """,
    "op8_line_dedup": """
        with lines as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
        windows as (select doc_id, i, l[i] as a, l[i + 1] as b, l[i + 2] as c
                    from (select doc_id, l, unnest(range(1, len(l) - 1)) as i from lines where len(l) >= 3)),
        ranked as (select doc_id, i, row_number() over (partition by a, b, c order by doc_id, i) as k from windows),
        gone as (select distinct doc_id, unnest([i, i + 1, i + 2]) as i from ranked where k > 1),
        per as (select doc_id, list(i) as gone from gone group by doc_id)
        select doc_id, len(l)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
               sha256(array_to_string(list_filter(l, lambda x, i: not list_contains(coalesce(gone, []), i)), chr(10))) as kept_sha256
        from lines left join per using (doc_id)
    """,
    "op9_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
        from t window w as (partition by t)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
