"""Registered queries of the operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.llm import quality as quality_rules
from tablewright.llm.frames import load
from tablewright.llm.language import fit_languages, identify_languages
from tablewright.llm.licences import document_licences, fit_licences
from tablewright.llm.mainline import main_texts
from tablewright.llm.mixture import BLOCK_WORDS, mixed_documents
from tablewright.llm.neardup import near_duplicates
from tablewright.llm.phrases import LEAST_COUNT, LONGEST, TOP, collocations
from tablewright.llm.pieces import encode_texts
from tablewright.llm.pseudonyms import pseudonymised
from tablewright.llm.subwords import fit_quality, score_quality
from tablewright.llm.toxicity import fit_toxicity, held_out, score_toxicity
from tablewright.llm.trie import prefix_trie
from tablewright.llm.vectors import near_vectors

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_quality_rules(spark, folder):
    counts = quality_rules.repetition_counts(load(spark, folder, "documents"))
    return quality_rules.verdicts(counts)


def _quality_sql():
    tops, dups = quality_rules.TOP_GRAMS, quality_rules.REPEATED_GRAMS
    q = quality_rules
    parts = [f"""
    d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {WORDS} as ws from documents),
    w as (select r, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from d),
    c as (select r, i, length(word) as chars from w),
    lines as (select r, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i, unnest(string_split(text, chr(10))) as line from d),
    full_lines as (select *, row_number() over (partition by r, line order by i) > 1 as again,
        list_sum(list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))) as chars
      from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    by_line as (select r, count(*) as n_lines, count(*) filter (again) as n_dup_lines,
        coalesce(sum(chars) filter (again), 0) as dup_line_chars from full_lines group by r)"""]
    joined, names = ["d left join by_line using (r)"], ["n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words"]
    for n in sorted({3, *tops, *dups}):
        parts.append(f"""
    g{n} as (select r, i, list_aggregate(ws[i:i + {n - 1}], 'string_agg', ' ') as gram
      from (select r, ws, unnest(range(1, len(ws) - {n - 2})) as i from d)),
    k{n} as (select r, i, gram, count(*) over (partition by r, gram) as times, row_number() over (partition by r, gram order by i) as nth from g{n})""")
        if n in tops:
            names.append(f"top_{n}gram_chars")
            joined.append(f"""(select r, max(times * (length(gram) - {n - 1})) as top_{n}gram_chars from k{n} where times > 1 group by r) using (r)""")
        if n in dups:
            names.append(f"dup_{n}gram_chars")
            joined.append(f"""(select r, sum(chars) as dup_{n}gram_chars from c semi join (select distinct r, i + o as i from k{n}, range({n}) t(o) where nth > 1) using (r, i) group by r) using (r)""")
        if n == 3:
            joined.append("""(select r, count(*) as n_repeat_words from (select distinct r, i + o from k3, range(3) t(o) where times > 1) group by r) using (r)""")
    bad = [f"100 * n_dup_lines > {q.LINE_SHARE} * n_lines", f"100 * dup_line_chars > {q.LINE_CHARS} * word_chars",
           f"100 * n_symbols > {q.SYMBOL_SHARE} * n_words"]
    bad += [f"100 * top_{n}gram_chars > {s} * word_chars" for n, s in tops.items()]
    bad += [f"100 * dup_{n}gram_chars > {s} * word_chars" for n, s in dups.items()]
    return f"""with {','.join(parts)},
    m as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, {', '.join(f'coalesce({c}, 0)::bigint as {c}' for c in names)}
      from {' left join '.join(joined)}),
    b as (select *, n_words < {q.BASE_WORDS} or 100 * n_repeat_words > {q.BASE_REPEATS} * n_words as base_failed from m)
    select *, not base_failed and not ({' or '.join(bad)}) as kept from b"""


def op2_minhash_near_dedup(spark, folder):
    return near_duplicates(load(spark, folder, "documents"), shingle=3, percent=85)


NEAR_SQL = f"""with recursive
    d as (select doc_id, {WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
    s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as g from d),
    n as (select doc_id, count(*) as n from s group by doc_id),
    c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
    e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
    r as (select doc_id, doc_id as root from documents
      union select f.b, r.root from r join (select a, b from e union all select b, a from e) f on f.a = r.doc_id),
    m as (select doc_id, min(root) as component_id from r group by doc_id)
    select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
    from m left join n using (doc_id)"""


def op3_language_id(spark, folder):
    return identify_languages(load(spark, folder, "pages"), fit_languages(load(spark, folder, "documents")))


def op4_toxicity(spark, folder):
    documents = load(spark, folder, "documents")
    labels = load(spark, folder, "labels").select("doc_id", "toxic").filter(~held_out())
    scored = score_toxicity(documents, fit_toxicity(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_pii_pseudonyms(spark, folder):
    return pseudonymised(load(spark, folder, "documents").select("doc_id", "text"), count="n_replaced")


def op6_licence_scan(spark, folder):
    return document_licences(load(spark, folder, "documents"), fit_licences(spark))


def op7_source_mixing(spark, folder):
    mixed = mixed_documents(load(spark, folder, "documents"))
    taken = F.aggregate("shard_words", F.lit(0).cast("long"), lambda at, x: at + x)
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


# Rows that agree in all of id, source and text are told apart by their number; the order of blocks has a digest of these.
MIX_SQL = f"""with r as (select doc_id, source, len({WORDS})::bigint as size,
        md5(concat_ws(chr(1), coalesce('=' || doc_id, '-'), coalesce('=' || source, '-'), coalesce(text, ''))) as doc from documents),
    d as (select *, row_number() over (partition by doc) - 1 as copy from r),
    s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
    s1 as (select *, [3.0::double, 1.0, 2.0][(i % 3 + 1)::int] as weight, 2.0::double * source_size as cap from s0),
    s2 as (select *, cap / weight as fill from s1),
    s3 as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
      from s2 window w as (order by fill, source nulls last rows between unbounded preceding and 1 preceding)),
    t as (select source, source_size, least(cap, weight * (select level from s3 where fill >= level order by fill, source nulls last limit 1)) as target from s3),
    b0 as (select doc, copy, source, size, unnest(range(0, ceil(size / {BLOCK_WORDS}.0)::bigint)) as block from d),
    b as (select *, least({BLOCK_WORDS}, size - {BLOCK_WORDS} * block) as words,
        ('0x' || md5(concat_ws(':', 'mix', doc, copy, block))[:15])::bigint as hash from b0),
    c as (select b.*, target, source_size, coalesce(sum(words) over (partition by b.source order by hash, doc, copy, block
        rows between unbounded preceding and 1 preceding), 0) as before from b join t on b.source is not distinct from t.source),
    k as (select doc, copy, sum(words * (floor(target / source_size) + (2 * before + words <= 2 * (target - floor(target / source_size) * source_size))::int)) as taken
      from c group by doc, copy)
    select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
    from d join t on d.source is not distinct from t.source left join k using (doc, copy)"""


def op8_embedding_near_dedup(spark, folder):
    return near_vectors(load(spark, folder, "embeddings"))


def op9_html_extraction(spark, folder):
    return main_texts(load(spark, folder, "pages"))


def op10_sentencepiece(spark, folder):
    return encode_texts(load(spark, folder, "documents"), check=True)


def op11_phrase_collocations(spark, folder):
    return collocations(load(spark, folder, "documents"))


PHRASE_SQL = f"""with
    p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
    t as (select lang, sum(len(ws))::bigint as n from w group by lang),
    g as (select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) as phrase from w, range(1, {LONGEST + 1}) s(m)),
    f as (select lang, m, phrase, count(*) as a from g group by all having count(*) >= {LEAST_COUNT}),
    c as (select *, string_split(phrase, ' ') as ws from f where m > 1),
    k as (select c.*, k from c, range(1, {LONGEST}) s(k) where k < m),
    j as (select k.lang, k.phrase, k.m, k.a, k.k, x.a as l, y.a as r, t.n, ((1000::hugeint * k.a * t.n) // (x.a::hugeint * y.a))::bigint as score
      from k join f x on x.lang = k.lang and x.phrase = array_to_string(ws[1:k], ' ')
      join f y on y.lang = k.lang and y.phrase = array_to_string(ws[k + 1:], ' ') join t on t.lang = k.lang),
    b as (select * from j qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    i as (select lang, a, unnest(list_transform(range(1, m - s.q + 2), lambda o: array_to_string(ws[o:o + s.q - 1], ' '))) as phrase from c, range(2, {LONGEST}) s(q) where s.q < m),
    h as (select lang, phrase, max(a) as longer from i group by all)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
    from b left join h using (lang, phrase) where longer is null or 100 * longer < 100 * a qualify rank <= {TOP}"""


def op12_conversation_trie(spark, folder):
    return prefix_trie(load(spark, folder, "conversations"))


def op13_quality_classifier(spark, folder):
    documents = load(spark, folder, "documents")
    labels = load(spark, folder, "labels").select("doc_id", "quality").filter(~held_out())
    scored = score_quality(documents, fit_quality(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


# Bit by bit over the bytes of decimal ids; DuckDB has no function for it.
CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
    lambda c, b: list_reduce([1, 1, 1, 1, 1, 1, 1, 1]::bigint[], lambda d, o: case when d & o = 1 then xor(d >> 1, 3988292384) else d >> 1 end, xor(c, b)), 4294967295::bigint))"""

TRIE_SQL = f"""with
    o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as i,
        coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    h as (select distinct conv_id, conv_id - conv_id % 20 as base, {CRC_SQL} % 4 as h from o),
    t as (select h.conv_id, o.i, role, text from h join o on o.conv_id = h.base and o.i <= h
      union all select h.conv_id, o.i + 1000000, role, text from h join o on o.conv_id = h.conv_id and o.i > h),
    s as (select conv_id, row_number() over (partition by conv_id order by i) as d, length(role)::varchar || ':' || role || text as turn, text from t),
    p as (select conv_id, d, string_agg(length(turn)::varchar || ':' || turn, '') over (partition by conv_id order by d) as path,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, max(d) over (partition by conv_id) as size from s
      union all select h.conv_id, 0, '', 0, (select count(*) from s where s.conv_id = h.conv_id) from h),
    n as (select path, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = size), '')) as ends_sha256 from p group by path),
    u as (select distinct a.path, b.path as up, b.d as up_depth, a.d from p a join p b on a.conv_id = b.conv_id and b.d <= a.d),
    k as (select up as path, count(*) as n_children from u where d = up_depth + 1 group by up),
    b as (select u.up as path, count(*) filter (k.path is null) as n_leaves, sum((n.n_convs - 1) * n.words)::bigint as saved_tokens
      from u join n using (path) left join k using (path) group by u.up)
    select n.conv_id, n.depth::bigint as depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
    from n join b using (path) left join k using (path) left join (select u.path, m.conv_id from u join n m on m.path = u.up where u.d = u.up_depth + 1) up on up.path = n.path"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_licence_scan": op6_licence_scan,
    "op7_source_mixing": op7_source_mixing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_quality_classifier": op13_quality_classifier,
}
COSINE_SQL = """with recursive
    v as (select vec_id, embedding::double[] as e from embeddings),
    g as (select vec_id, e, sqrt(list_dot_product(e, e)) as size from v
      where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) / a.size / b.size >= 0.9 else false end),
    r as (select vec_id, vec_id as root from v union select l.b, r.root from r join l on l.a = r.vec_id),
    m as (select vec_id, min(root) as component_id from r group by vec_id),
    n as (select a, count(*) as n from l group by a)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from m left join n on n.a = m.vec_id"""

ORACLES = {
    "op1_quality_rules": _quality_sql(),
    "op2_minhash_near_dedup": NEAR_SQL,
    "op7_source_mixing": MIX_SQL,
    "op8_embedding_near_dedup": COSINE_SQL,
    "op11_phrase_collocations": PHRASE_SQL,
    "op12_conversation_trie": TRIE_SQL,
}
