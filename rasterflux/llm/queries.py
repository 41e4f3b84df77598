"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterflux.llm import (
    hard_negatives,
    html_extract,
    lm_scoring,
    merkle,
    mixing,
    oddsketch,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sanitise,
    sharding,
    toxicity,
)
from rasterflux.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.stored(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(led).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(table(spark, sf_dir, "documents"))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op4(table(spark, sf_dir, "documents"))


def op5_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.op5(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.op8(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op9(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op11_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.op11(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op12(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op13(table(spark, sf_dir, "conversations"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy rejects, alone and with others, from the stored ledger."""
    return quality_rules.ablations(quality_rules.stored(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_toxicity,
        op3_mixing,
        op4_merkle_fingerprints,
        op5_odd_sketches,
        op6_sharding,
        op7_lm_scoring,
        op8_quality_classifier,
        op9_packing,
        op10_html_extraction,
        op11_sanitisation,
        op12_hard_negatives,
        op13_prefix_trie,
        rule_ablations,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+')"
_OP1 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text,'') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i+7],' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w)-6)) AS i FROM d)),
p AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) >= 2),
cov AS (SELECT rid, sum(least(8, coalesce(nxt-i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM p) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w,'')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t,'[^#*$%&|<>]+','','g')) AS BIGINT) AS n_symbols, list_filter(string_split(t,chr(10)), lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')) AS l,
 CAST(coalesce(cov.n,0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t,'\P{{Lu}}+','','g')) AS n_upper FROM d LEFT JOIN cov USING (rid)),
r AS (SELECT *, CAST(len(l)-len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM m),
b AS (SELECT *, CAST((n_words<20)::INT + 2*(100*n_repeat_words>30*n_words)::INT + 4*(20*n_symbols>word_chars)::INT + 8*(100*n_dup_lines>30*len(l))::INT
 + 16*(2*n_upper>word_chars)::INT + 32*(word_chars>20*n_words)::INT AS BIGINT) AS fail_bits FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3)<>0 AS base_failed, fail_bits=0 AS kept, fail_bits FROM b"""
_OP3 = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST(('0x'||substr(md5('mix-2:'||coalesce(CAST(doc_id AS VARCHAR),'?')||':'||md5(coalesce(text,''))),1,13)) AS BIGINT)/4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT *, (size*1000)//(size+100) AS w, length(bin(size))*8+(size*8)//(1::BIGINT<<(length(bin(size))-1)) AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(w*size) AS BIGINT) AS source_w, [1,2,3][(row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1] AS weight FROM k GROUP BY source),
l AS (SELECT *, 3*source_size AS cap, row_number() OVER (ORDER BY 3*source_size/weight::DOUBLE, source NULLS LAST) AS pos FROM s),
z AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS DOUBLE) / CAST(sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS kappa FROM l),
v AS (SELECT min_by(kappa, pos) AS kappa FROM z WHERE kappa*weight<=cap),
t AS (SELECT z.source, source_size, source_w, CASE WHEN v.kappa IS NULL OR v.kappa*weight>cap THEN CAST(cap AS DOUBLE) ELSE v.kappa*weight END AS target, CAST(greatest(source_size,1) AS DOUBLE) AS whole FROM z, v),
m AS (SELECT k.*, source_size, target, CAST(round_even((target/whole+least(target/whole,3-target/whole)*((w*whole-source_w)/(1000.0::DOUBLE*whole)))*1000000.0::DOUBLE,0) AS BIGINT) AS mu FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, mu//1000000 AS certain, mu%1000000 AS p FROM m),
c AS (SELECT source, class, CAST(sum(p) AS BIGINT) AS sum_p, CAST(sum(p*size) AS BIGINT)/CAST(greatest(sum(p),1) AS DOUBLE) AS mean_size, count(*) AS class_rows, sum(p)/1000000.0::DOUBLE AS e, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS i FROM q GROUP BY source, class),
f AS (SELECT source, 0::BIGINT AS i, 0::BIGINT AS up, 0.0::DOUBLE AS carry FROM t UNION ALL SELECT f.source, c.i, y.up, f.carry+(e-floor(e))*mean_size-CASE WHEN y.up=1 THEN mean_size ELSE 0.0::DOUBLE END
 FROM f JOIN c ON c.source IS NOT DISTINCT FROM f.source AND c.i=f.i+1, LATERAL (SELECT (f.carry+(e-floor(e))*mean_size>=mean_size/2 AND e>floor(e))::BIGINT AS up) y),
n AS (SELECT c.source, class, CAST(floor(e) AS BIGINT)+up AS n, greatest(sum_p,1)/CAST(class_rows*1000000 AS DOUBLE) AS mean FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source AND c.i=f.i),
o AS (SELECT q.*, n, u*(1-p/1000000.0::DOUBLE)*mean AS a, (1-u)*(p/1000000.0::DOUBLE)*(1-mean) AS b FROM q JOIN n ON q.source IS NOT DISTINCT FROM n.source AND q.class=n.class),
r AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY CASE WHEN p=0 THEN 1.0::DOUBLE WHEN a+b=0 THEN 0.0::DOUBLE ELSE a/(a+b) END, u, doc_id, size) AS rank FROM o)
SELECT doc_id, size, source_size, target, CAST(size*copies AS BIGINT) AS taken, copies, p AS inclusion_millionths FROM (SELECT *, CAST(certain+(rank<=n)::INT AS INT) AS copies FROM r)"""


def _merkle(t: str, a: str) -> str:
    """Columns v (leaf hashes per line), then s (sections) and l (least leaves)."""
    return rf"""list_transform(string_split({t},chr(10)), lambda p: list_transform(regexp_extract_all(p,'[^.!?]+[.!?]*|[.!?]+'), lambda x: md5(x))) AS v{a}"""


def _nodes(a: str) -> str:
    return rf"""list_transform(string_split(regexp_replace(array_to_string(list_transform(v{a}, lambda x: substr(md5(array_to_string(x,'')),1,16)),' '),'\b([01][0-9a-f]{{15}}) ','\1|','g'),'|'), lambda x: md5(x)) AS s{a},
 list_sort(list_distinct(list_transform(flatten(v{a}), lambda x: substr(x,1,12))))[1:{merkle.SKETCH}] AS l{a}"""


def _print(a: str) -> str:
    return f"md5(array_to_string(s{a},' '))||'/'||array_to_string(list_transform(s{a}, lambda x: substr(x,1,8)),'')||'/'||array_to_string(l{a},'')"


def _near(a: str, b: str) -> str:
    both = f"list_sort(list_distinct(list_concat(l{a},l{b})))[1:{merkle.SKETCH}]"
    common = f"len(list_intersect({both},list_intersect(l{a},l{b})))"
    return f"CASE WHEN s{a}=s{b} THEN 1.0::DOUBLE WHEN len(l{a})+len(l{b})=0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE*{common}/(len({both})+{common}) END"


_OP4 = f"""WITH d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents), n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx, CAST(length(t) AS BIGINT) AS n_chars FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(t))),
e AS (SELECT *, substr(t,1,n_chars-n_chars//2)||substr(nx,1,n_chars//2) AS ed FROM n),
h AS (SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {_merkle("t", "1")}, {_merkle("ed", "2")}, {_merkle("nx", "3")} FROM e),
f AS (SELECT *, {_nodes("1")}, {_nodes("2")}, {_nodes("3")} FROM h)
SELECT doc_id, n_chars, edited_sha256, {_print("1")} AS fingerprint, {_print("2")} AS edited_fingerprint, {_near("1", "2")} AS near_edited, {_near("1", "3")} AS near_next,
 CAST(len(list_filter(list_distinct(s1), lambda x: NOT list_contains(s2, x))) AS INT) AS n_changed_sections FROM f"""

_ABLATIONS = f"""WITH b AS ({_OP1}), r AS (SELECT unnest({list(quality_rules.DEFAULT_POLICY.rules)}) AS rule, unnest({[quality_rules.BIT[r] for r in quality_rules.DEFAULT_POLICY.rules]}) AS bit)
SELECT rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits = bit) AS n_only, count(*) FILTER (WHERE fail_bits <> 0) AS n_rejected, CAST(bit_or(fail_bits) AS BIGINT) AS bits_seen FROM b, r GROUP BY 1"""

_CRC_TABLE = "SELECT list(list_reduce([i,0,0,0,0,0,0,0,0], lambda x, y: xor(x>>1, CASE WHEN x&1=1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR),''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: xor(a>>8, tab[(xor(a,b)&255)+1])), 4294967295)"
_OP13 = rf"""WITH t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role,''))||':'||coalesce(role,'')||coalesce(text,'')) AS k, CAST(len({_WORDS}) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS d FROM t), tab AS ({_CRC_TABLE}),
c AS (SELECT conv_id, conv_id-conv_id%20 AS base, n, {_CRC}%4 AS h FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY 1), tab),
x AS (SELECT c.conv_id, c.h, least(c.h, coalesce(b.n,0)) AS lent, c.base FROM c LEFT JOIN c b ON b.conv_id=c.base),
r AS (SELECT x.conv_id, o.d, o.k, o.w FROM x JOIN o ON o.conv_id=x.base AND o.d<=x.h UNION ALL SELECT x.conv_id, o.d-x.h+x.lent, o.k, o.w FROM x JOIN o ON o.conv_id=x.conv_id AND o.d>x.h),
l AS (SELECT conv_id, list(k ORDER BY d) AS ks, list(w ORDER BY d) AS ws FROM r GROUP BY 1),
e AS (SELECT x.conv_id, coalesce(ks,[]) AS ks, coalesce(ws,[]) AS ws FROM x LEFT JOIN l ON l.conv_id=x.conv_id),
p AS (SELECT conv_id, d, md5(array_to_string(ks[1:d],' ')) AS node, CASE WHEN d>0 THEN md5(array_to_string(ks[1:d-1],' ')) END AS parent, CASE WHEN d>0 THEN ws[d] ELSE 0 END AS w, d=len(ks) AS ends FROM (SELECT *, unnest(range(len(ks)+1)) AS d FROM e)),
n AS (SELECT d, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY d, node),
k AS (SELECT d-1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d>0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children,0) AS n_children FROM n LEFT JOIN k ON k.d=n.d AND k.node=n.node),
a AS (SELECT p.d, p.node, sum((m.n_convs-1)*m.w) AS saved, sum((m.n_children=0)::INT) AS leaves FROM m JOIN p ON p.conv_id=m.conv_id AND p.d<=m.d GROUP BY 1, 2)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN a ON a.d=m.d AND a.node=m.node LEFT JOIN m q ON q.d=m.d-1 AND q.node=m.parent"""

#: The patterns of personal data as the contract states them.
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_ANY = "|".join((_KINDS["email"], _KINDS["ip"], _KINDS["phone"], r"[0-9](?:[\x20-]?[0-9]){15,}"))
_LETTERS = r"\p{L}\p{M}\p{N}"


def _valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m},'[^0-9]','','g')"
    digit = f"CAST(substr({digits}, length({digits})-i+1, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(1, length({digits})+1), lambda i: CASE WHEN i%2=1 THEN {digit} ELSE 2*{digit}-CASE WHEN {digit}>4 THEN 9 ELSE 0 END END))%10=0"
    return {
        "email": "true",
        "ip": rf"regexp_matches({m},'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)(?:\.|$)){{4}}$')",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }[kind]


def _found(kind: str) -> str:
    start = f"CAST(coalesce(list_sum(list_transform({kind}_g[1:k], lambda x: length(x))),0)+coalesce(list_sum(list_transform({kind}_m[1:k-1], lambda x: length(x))),0) AS BIGINT)"
    at = f"list_transform(range(1, len({kind}_m)+1), lambda k: '{kind}:'||{start}||':'||({start}+length({kind}_m[k])))"
    ok = f"list_transform({kind}_m, lambda m: {_valid(kind, 'm')})"
    return f"list_transform(list_filter(list_zip({at}, {ok}), lambda z: z[2]), lambda z: z[1]) AS {kind}"


_SPLIT = ", ".join(f"regexp_extract_all(t,'{p}') AS {k}_m, string_split_regex(t,'{p}') AS {k}_g" for k, p in _KINDS.items())
_TERMS = lambda x: f"list_filter(string_split_regex(lower({x}),'[^{_LETTERS}]+'), lambda w: length(w)>=3)"
_WITH_STEMS = lambda x: f"list_distinct(list_concat({x}, list_transform({x}, lambda w: substr(w,1,3)||'*')))"
_DIGITS = "regexp_replace(h,'[^0-9]','','g')"
_ENTITY = f"""CASE WHEN contains(h,'@') THEN 'email:'||lower(h) WHEN regexp_full_match(h,'{_KINDS["ip"]}') THEN CASE WHEN {_valid("ip", "h")} THEN 'ip:'||h END
 WHEN h[1]='+' THEN CASE WHEN {_valid("phone", "h")} THEN 'phone:'||{_DIGITS} END WHEN {_valid("card", "h")} THEN 'card:'||{_DIGITS} END"""
_OP11 = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text,'') AS t FROM documents), m AS (SELECT *, {_SPLIT} FROM d),
b AS (SELECT row, doc_id, t, {", ".join(map(_found, _KINDS))} FROM m), c AS (SELECT *, list_concat(list_concat(email, ip), list_concat(card, phone)) AS base FROM b),
n AS (SELECT row, regexp_extract_all(t,'{_ANY}') AS hits, string_split_regex(t,'{_ANY}') AS gaps FROM c WHERE len(base)>0),
g AS (SELECT row, hits, list_transform(gaps, lambda x: {_TERMS("x")}) AS ts FROM n), u AS (SELECT row, hits, ts, unnest(range(1, len(hits)+1)) AS i FROM g),
e AS (SELECT row, hits[i] AS h, list_concat(list_reverse(list_reverse(ts[i])[1:10]), ts[i+1][1:10]) AS near FROM u), f AS (SELECT row, {_ENTITY} AS entity, near FROM e),
s AS (SELECT row, entity, list_sort({_WITH_STEMS("list_distinct(flatten(list(near)))")}) AS terms FROM f WHERE entity IS NOT NULL GROUP BY row, entity),
ne AS (SELECT entity, count(*) AS n_e FROM s GROUP BY 1), pt AS (SELECT entity, terms, unnest(terms) AS term FROM s),
pr AS (SELECT entity, term, count(*) AS n_et FROM pt GROUP BY 1, 2 HAVING count(DISTINCT terms)>=3),
dt AS (SELECT row, unnest({_WITH_STEMS(_TERMS(f"regexp_replace(t,'{_ANY}',' ','g')"))}) AS term FROM d), nt AS (SELECT term, count(*) AS n_t FROM dt GROUP BY 1), z AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
told AS (SELECT DISTINCT term FROM pr JOIN ne USING (entity) JOIN nt USING (term), z WHERE n>n_e AND ln(n*n_et/(n_e*n_t))>=0.8::DOUBLE*ln(n/n_e)-0.000000001::DOUBLE),
w AS (SELECT row, regexp_extract_all(t,'{_ANY}|[{_LETTERS}]+') AS ws, string_split_regex(t,'{_ANY}|[{_LETTERS}]+') AS gs FROM d),
x AS (SELECT row, unnest(range(1, len(ws)+1)) AS i, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap FROM w),
y AS (SELECT row, i, lower(word) AS term, CAST(sum(length(gap)+length(word)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS en, length(word) AS l FROM x),
k AS (SELECT row, list('term:'||(en-l)||':'||en ORDER BY i) AS terms FROM y WHERE term IN (SELECT term FROM told) GROUP BY row)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip, CAST(len(card) AS BIGINT) AS n_card, CAST(len(phone) AS BIGINT) AS n_phone,
 sha256(array_to_string(base, ',')) AS base_sha256, array_to_string(list_concat(base, coalesce(terms, [])), ',') AS spans, CAST(len(coalesce(terms, [])) AS BIGINT) AS n_terms FROM c LEFT JOIN k USING (row)"""
_OP12 = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id%7=0 THEN (label+1)%10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256*CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS id, a.label=c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1]*z[2])) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id%100=0 AND a.r<>c.r),
p AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k<=5),
n AS (SELECT p.r, p.k, p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id) AS rank
 FROM p JOIN s ON s.r=p.r AND NOT s.same AND 80*positive_score<=100*s.score AND 100*s.score<=100*positive_score QUALIFY rank<=5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op3_mixing": _OP3, "op4_merkle_fingerprints": _OP4, "op11_sanitisation": _OP11, "op12_hard_negatives": _OP12, "op13_prefix_trie": _OP13, "rule_ablations": _ABLATIONS}
