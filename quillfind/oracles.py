"""DuckDB SQL with the same results as the registered queries, over views of the test tables."""

from __future__ import annotations

import re

from .functions.text import COMPARISONS, CONJUNCTIONS, COVERAGE_STOP_WORDS, STOP_WORDS, SUFFIXES, TEMPLATES, W


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{W}'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{W}', ''), '{W}$', '')"


def tokens(x: str) -> str:
    rules = []
    for suffix, least, drop, put in SUFFIXES:
        more = " and substr(t, length(t) - 1, 1) not in ('s', 'u')" if suffix == "s" else ""
        rules.append(f"when ends_with(t, '{suffix}') and length(t) > {least}{more} then left(t, length(t) - {drop}) || '{put}'")
    kept = rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]{{2,}}') and not list_contains({_list(STOP_WORDS)}, t))"
    return f"list_transform({kept}, lambda t: case {' '.join(rules)} else t end)"


def context(x: str, limit: int = 100) -> str:
    made = f"'Document begins: ' || case when contains({x}, '. ') then split_part({x}, '. ', 1) else substr({x}, 1, {limit}) end || '.'"
    return f"case when len({words(made)}) > {limit} then array_to_string(({words(made)})[1:{limit}], ' ') || '...' else {made} end"


DOCS = "docs as (select doc_id, coalesce(text, '') as text from documents)"
QUERY = "q as (select item_id as query_id, coalesce(text, '') as text from benchmark)"


def chunks(size: int = 200, overlap: int = 50, contextual: bool = False) -> str:
    step = size - overlap
    if contextual:
        return f"{DOCS}, w as (select doc_id, {context('text')} as ctx, {words('text')} as w from docs), chunks as (select doc_id, cast(i // {step} as int) as chunk_idx, ctx, ctx || ' ' || array_to_string(w[i + 1 : i + {size}], ' ') as text from w, unnest(range(0, len(w), {step})) as u(i))"
    return f"{DOCS}, w as (select doc_id, {words("' ' || text")} as w from docs), chunks as (select doc_id, cast(i // {step} as int) as chunk_idx, array_to_string(w[i + 1 : i + {size}], ' ') as text from w, unnest(range(0, len(w), {step})) as u(i))"


def index() -> str:
    return f"""
        tok as (select doc_id, chunk_idx, {tokens('text')} as t from chunks),
        st as (select count(*)::double as n, avg(len(t)) as avgdl from tok),
        post as (select doc_id, chunk_idx, dl, term, count(*) as tf from (select doc_id, chunk_idx, len(t) as dl, unnest(t) as term from tok) group by all),
        raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post, st group by term),
        idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
        idf2 as (select term, ln((n - df + 0.5) / (df + 0.5) + 1) as idf from raw, st)"""


QT = f"qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens('text')}) as term from q) group by all)"
WEIGHT = "tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"
CS = f"cs as (select query_id, doc_id, chunk_idx, sum(qtf * idf * {WEIGHT}) as score from qt join post using (term) join idf using (term), st group by all)"


def top(rel: str, k: int, digits: int = 6) -> str:
    return f"select query_id, doc_id, score, cast(rank as int) as rank from (select query_id, doc_id, round(score, {digits}) as score, row_number() over (partition by query_id order by round(score, {digits}) desc, doc_id) as rank from {rel}) where rank <= {k}"


def bm25(k: int, name: str, contextual: bool = False, zero: bool = False) -> str:
    """CTEs up to the run `name`."""
    pooled = "ds as (select query_id, doc_id, max(score) as score from cs group by all)"
    if zero:
        pooled += ", dz as (select q.query_id, d.doc_id, coalesce(ds.score, 0.0) as score from q cross join docs d left join ds on ds.query_id = q.query_id and ds.doc_id = d.doc_id)"
    return f"{index()}, {QT}, {CS}, {pooled}, {name} as ({top('dz' if zero else 'ds', k)})"


def places(rel: str, keys: str, x: str, d: int = 64) -> str:
    """Non-zero places of the hash encoder: keys, b, x."""
    return f"select {keys}, b, sum(sgn) as x from (select {keys}, ('0x' || substr(md5(term), 1, 8))::bigint % {d} as b, case when ('0x' || substr(md5(term), 9, 1))::bigint % 2 = 0 then 1 else -1 end as sgn from (select {keys}, unnest({tokens(x)}) as term from {rel})) group by all having sum(sgn) <> 0"


def second(ctes: str) -> str:
    """A dense retrieval's CTEs for a second set of queries: other names, without the chunks' vectors."""
    kept = ctes[ctes.index("qv as (") :]
    for name in ("qv", "qn", "dc", "dd"):
        kept = re.sub(rf"\b{name}\b", f"{name}2", kept)
    return kept


def token_vectors(rel: str, key: str, text: str, name: str, d: int = 32) -> str:
    """CTEs of the token encoder: {name}t (key, t), {name}w (key, i, w: the token and its neighbours as one string),
    and for every distinct window {name}p (w, b, x): its unit vector's places that are not zero."""
    return f"""
        {name}t as (select {key}, {tokens(text)} as t from {rel}),
        {name}w as (select {key}, i, list_sort(list_filter([t[i - 1], t[i], t[i + 1]], lambda x: x is not null)) as w, len(t) as n from {name}t, unnest(range(1, len(t) + 1)) as u(i)),
        {name}r as (select w, ('0x' || substr(md5(term), 1, 8))::bigint % {d} as b, sum(case when ('0x' || substr(md5(term), 9, 1))::bigint % 2 = 0 then 1 else -1 end) as x from (select w, unnest(w) as term from (select distinct w from {name}w)) group by all having sum(case when ('0x' || substr(md5(term), 9, 1))::bigint % 2 = 0 then 1 else -1 end) <> 0),
        {name}p as (select w, b, x / sqrt(sum(x * x) over (partition by w)) as x from {name}r)"""


def dense(k: int, name: str, queries: str = "q") -> str:
    return f"""
        cv as ({places('chunks', 'doc_id, chunk_idx', 'text')}), cn as (select doc_id, chunk_idx, sqrt(sum(x * x)) as n from cv group by all),
        qv as ({places(queries, 'query_id', 'text')}), qn as (select query_id, sqrt(sum(x * x)) as n from qv group by all),
        dc as (select query_id, doc_id, chunk_idx, sum(qv.x * cv.x) as s from qv join cv using (b) group by all),
        dd as (select query_id, doc_id, max(round(s / (qn.n * cn.n), 9)) as score from dc join cn using (doc_id, chunk_idx) join qn using (query_id) group by all),
        {name} as ({top('dd', k)})"""


def rrf(a: str, b: str, k: int = 10) -> str:
    return f"f as (select query_id, doc_id, sum(1.0 / (60 + rank)) as score from (select query_id, doc_id, rank from {a} union all select query_id, doc_id, rank from {b}) group by all) {top('f', k)}"


def sparse(k: int, name: str) -> str:
    return f"""
        stok as (select doc_id, chunk_idx, {tokens('text')} as t from chunks), sn as (select count(*)::double as n from stok),
        sp as (select doc_id, chunk_idx, term, ln(1 + count(*)) as w from (select doc_id, chunk_idx, unnest(t) as term from stok) group by all),
        sdf as (select term, ln((any_value(n) + 1) / (count(*) + 1)) + 1 as idf from sp, sn group by term),
        sq as (select query_id, term, any_value(w) * coalesce(any_value(idf), ln(any_value(n) + 1) + 1) as w from (select query_id, term, ln(1 + count(*)) as w from (select query_id, unnest({tokens('text')}) as term from q) group by all) left join sdf using (term), sn group by query_id, term),
        sqn as (select query_id, sqrt(sum(w * w)) as n from sq group by all), scn as (select doc_id, chunk_idx, sqrt(sum(w * w)) as n from sp group by all),
        sd as (select query_id, doc_id, chunk_idx, sum(sp.w * sq.w) as s from sp join sq using (term) group by all),
        ss as (select query_id, doc_id, max(s / (greatest(scn.n, 1e-8) * greatest(sqn.n, 1e-8))) as score from sd join scn using (doc_id, chunk_idx) join sqn using (query_id) group by all),
        {name} as ({top('ss', k)})"""


def hypothetical(x: str) -> str:
    c = rf"regexp_replace(regexp_replace({strip(x)}, '\?+$', ''), '\.+$', '')"
    n = f"list_sum(list_transform(range(1, 33), lambda i: ('0x' || substr(md5({x}), i, 1))::bigint)) % 3"
    filled = ["'" + t.replace("'", "''").replace("{q}", f"' || {c} || '").replace("{low}", f"' || lower({c}) || '") + "'" for t in TEMPLATES]
    return f"case {n} when 0 then {filled[0]} when 1 then {filled[1]} else {filled[2]} end"


def decomposed(x: str) -> str:
    rules = []
    for c in CONJUNCTIONS:
        rules.append(f"when contains(lower({x}), '{c}') and len(string_split({x}, '{c}')) = 2 then list_filter(list_transform(string_split({x}, '{c}'), lambda p: {strip('p')}), lambda p: p <> '')")
    rules.append("when " + " or ".join(f"contains(lower({x}), '{c}')" for c in COMPARISONS) + f" then [{x}]")
    for c in (" that ", " which "):
        parts = f"[{strip(f'substr({x}, 1, instr({x}, {chr(39)}{c}{chr(39)}) - 1)')}, {strip(f'substr({x}, instr({x}, {chr(39)}{c}{chr(39)}) + {len(c)})')}]"
        rules.append(f"when (contains(lower({x}), ' who ') or contains(lower({x}), ' what ')) and contains({x}, '{c}') then list_filter({parts}, lambda p: p <> '')")
    return f"case {' '.join(rules)} else [{x}] end"


def broaden(x: str) -> str:
    return f"case when len({words(x)}) > 5 then array_to_string(({words(x)})[1 : len({words(x)}) // 2], ' ') else {x} end"


def coverage(x: str, ctx: str) -> str:
    keys = f"list_filter(list_distinct({words(f'lower({x})')}), lambda w: not list_contains({_list(COVERAGE_STOP_WORDS)}, w))"
    return f"case when len({keys}) > 0 then len(list_filter({keys}, lambda w: contains(lower(coalesce({ctx}, '')), w))) / len({keys}) end"


def sentences(x: str, line_ends: bool = False) -> str:
    pattern = r"\. |! |\? |\.\n" + (r"|!\n|\?\n" if line_ends else "")
    return f"list_filter(list_transform(string_split_regex({x}, '{pattern}'), lambda s: {strip('s')}), lambda s: length(s) > 10)"


def summary(kind: str, k: int) -> str:
    n_words = f"len({words('s')})"
    if kind == "a":
        scored = f"select doc_id, s, i, round(0.6 / (1 + i * 0.3) + 0.4 * least({n_words} / 20.0, 1.0), 9) as score from ss"
    else:
        low = words("lower(s)")
        scored = f"select doc_id, s, i, round(0.5 * coalesce(tf, 0) + 0.3 / (1 + i * 0.2) + 0.2 * least({n_words} / 15.0, 1.0), 9) as score from ss left join (select doc_id, i, sum(coalesce(n, 0)) / any_value(top) / count(*) as tf from (select doc_id, i, unnest({low}) as word from ss) left join f using (doc_id, word) left join (select doc_id, max(n) as top from f group by all) using (doc_id) group by all) using (doc_id, i)"
    freq = f"f as (select doc_id, word, count(*) as n from (select doc_id, unnest({words('lower(s)')}) as word from ss) where length(word) > 2 group by all)," if kind == "b" else ""
    return f"""
        with {DOCS}, sl as (select doc_id, text, {sentences('text', kind == 'a')} as l from docs),
        ss as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) - 1 as i from sl), {freq}
        sc as ({scored}),
        best as (select doc_id, string_agg(s, '. ' order by i) as best from (select *, row_number() over (partition by doc_id order by score desc, i) as rn from sc) where rn <= {k} group by all)
        select doc_id, md5(case when {strip('text')} = '' then '' when len(l) = 0 then substr(text, 1, 500) when len(l) <= {k} then array_to_string(l, '. ') else best end) as summary_md5 from sl left join best using (doc_id)"""


QRELS = "rel as (select b.item_id as query_id, d.doc_id, 1 as rel from benchmark b join documents d on contains(d.text, b.text) where b.text <> '')"


def metrics(run: str, ks: tuple[int, ...], name: str) -> str:
    """CTEs up to `name`: query_id, metric, k, value."""
    parts = []
    for k in ks:
        parts.append(f"select query_id, {k} as k, sum(case when rank <= {k} then rel * ln(2) / ln(rank + 1) end) as dcg, sum(case when rank <= {k} then rel end) as hits, sum(case when rank <= {k} and rel > 0 then seen / rank end) as ap from {name}_h group by query_id")
    ideal = " union all ".join(f"select query_id, {k} as k, sum(case when rank <= {k} then ln(2) / ln(rank + 1) end) as idcg, count(*) as n from {name}_i group by query_id" for k in ks)
    value = "coalesce({}, 0.0)"
    rows = [("ndcg", value.format("dcg / idcg")), ("map", value.format("ap / n")), ("recall", value.format("hits / n")), ("precision", value.format("hits / k"))]
    return f"""
        {name}_r as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id::varchar) as rank from {run}),
        {name}_h as (select query_id, rank, rel, sum(rel) over (partition by query_id order by rank) as seen from (select r.query_id, r.rank, coalesce(rel.rel, 0) as rel from {name}_r r left join rel using (query_id, doc_id))),
        {name}_i as (select query_id, row_number() over (partition by query_id order by doc_id) as rank from rel),
        {name}_k as ({ideal}), {name}_v as ({' union all '.join(parts)}),
        {name} as ({' union all '.join(f"select query_id, '{m}' as metric, k, {v} as value from {name}_k left join {name}_v using (query_id, k)" for m, v in rows)})"""


TOKENS = """
    d as (select vec_id // 8 as doc_id, cast(vec_id % 8 as int) as tok_idx, embedding::double[] as emb from embeddings),
    q as (select doc_id as query_id, tok_idx, emb from d where doc_id % 50 = 0),
    c as (select cast(vec_id as int) as centroid_id, embedding::double[] as vec from embeddings where vec_id < 16)"""
NEAR = """
    dn as (select doc_id, tok_idx, emb, centroid_id, vec, row_number() over (partition by doc_id, tok_idx order by round(list_sum(list_transform(list_zip(emb, vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6), centroid_id) as rn from d, c),
    qn as (select query_id, tok_idx, centroid_id, row_number() over (partition by query_id, tok_idx order by round(list_sum(list_transform(list_zip(emb, vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), centroid_id) as rn from q, c)"""


def maxsim(docs: str, name: str, pairs: str | None = None) -> str:
    where = f" join {pairs} p on p.query_id = q.query_id and p.doc_id = d.doc_id" if pairs else ""
    return f"{name} as (select query_id, doc_id, sum(m) as score from (select q.query_id, q.tok_idx, d.doc_id, max(list_cosine_similarity(q.emb, d.emb)) as m from q cross join {docs} d{where} group by all) group by all)"


def _approx(k: int, probe: int) -> str:
    return f"""{TOKENS}, {NEAR},
        ov as (select query_id, doc_id, count(*) as overlap from (select distinct query_id, centroid_id from qn where rn <= {probe}) join (select distinct doc_id, centroid_id from dn where rn = 1) using (centroid_id) group by all),
        cand as (select query_id, doc_id from (select *, row_number() over (partition by query_id order by overlap desc, doc_id) as r from ov) where r <= greatest({5 * k}, cast(floor((select count(distinct doc_id) from d) * 0.1) as int))),
        {maxsim('d', 'ms', 'cand')}"""


CODEC = f"""{TOKENS}, {NEAR},
    res as (select doc_id, tok_idx, centroid_id, vec, unnest(list_transform(list_zip(emb, vec), lambda p: p[1] - p[2])) as r, generate_subscripts(emb, 1) as dim from dn where rn = 1),
    bo as (select dim, min(r) as lo, max(r) as hi from res group by all),
    back as (select doc_id, tok_idx, centroid_id, dim, vec[dim] + least(greatest(floor(round((r - lo) / greatest(hi - lo, 1e-8) * 4, 9)), 0), 3) / 4.0 * (hi - lo) + lo as x from res join bo using (dim)),
    b as (select doc_id, tok_idx, any_value(centroid_id) as centroid_id, list(x order by dim) as emb from back group by all)"""

_PAIR = f"with {chunks()}, {QUERY}, {bm25(10, 'ra')}, {dense(10, 'rb')}"
_DIFF = f"{_PAIR}, {QRELS}, {metrics('ra', (10,), 'ma')}, {metrics('rb', (10,), 'mb')}, df as (select q.query_id, coalesce(a.value, 0) - coalesce(b.value, 0) as diff from q left join (select * from ma where metric = 'ndcg') a using (query_id) left join (select * from mb where metric = 'ndcg') b using (query_id))"
_PAGES = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<title>.*?</title>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_POOL = {"mean": "avg(x)", "max": "max(x)", "cls": "min_by(x, tok_idx)"}

ORACLES: dict[str, str] = {
    "full_text": f"select p_partkey, md5({strip("p_name || ' ' || p_type")}) as full_md5 from part",
    "titled_pages": f"select page_id as doc_id, regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1) as title, md5({_PAGES}) as text_md5 from pages",
    "chunk_200_50": f"with {chunks()} select doc_id, chunk_idx, md5(text) as chunk_md5, cast(len({words('text')}) as int) as n_words from chunks",
    "chunk_100_0": f"with {chunks(100, 0)} select doc_id, chunk_idx, doc_id || '::l0::' || chunk_idx as chunk_id, md5(text) as chunk_md5 from chunks",
    "contextual_chunks": f"with {chunks(contextual=True)} select doc_id, chunk_idx, md5(text) as chunk_md5, cast(len({words('ctx')}) as int) as context_words from chunks",
    "contextual_chunks_titled": "select p_partkey as doc_id, 0 as chunk_idx, 'Document title: ' || p_name || '. ' || p_type as text from part",
    "tokenize_stem": f"select doc_id, cast(len({tokens('text')}) as int) as n_tokens, md5(array_to_string({tokens('text')}, ' ')) as tokens_md5 from documents",
    "term_df": f"with {chunks()}, {index()} select term, df from raw",
    "sentence_split": f"select doc_id, cast(len({sentences('text')}) as int) as n, md5(array_to_string({sentences('text')}, '|')) as sentences_md5 from documents",
    "extractive_summary_a": summary("a", 3),
    "extractive_summary_b": summary("b", 5),
    "hyde_template": f"select item_id, {hypothetical('text')} as hypothetical from benchmark",
    "decompose_query": f"select conv_id, turn, cast(len({decomposed('text')}) as int) as n, array_to_string({decomposed('text')}, ' | ') as parts from conversations where role = 'user'",
    "decompose_rules": "select * from (values (1, 'cats | dogs?'), (2, 'difference between a | b'), (3, 'compare x to y'), (4, 'tell me who wrote the book | won'), (5, 'say what it is | shines'), (6, 'A AND B'), (7, 'a and b and c'), (8, 'plain')) t(id, parts)",
    "reformulate_query": f"select conv_id, turn, {broaden('text')} as broader, text as specific from conversations where role = 'user'",
    "keyword_coverage": f"select b.item_id, round({coverage('b.text', 'd.text')}, 6) as coverage from benchmark b left join documents d on d.doc_id = b.item_id",
    "node_ids": "select item_id, 'l1::c' || (item_id % 5) || '::' || substr(md5(text), 1, 8) as node_id from benchmark",
    "bm25_topk": f"with {chunks()}, {QUERY}, {bm25(10, 'run')} select * from run",
    "bm25_idf": f"with {chunks()}, {index()} select term, df, round(idf, 6) as idf from idf",
    "bm25_zero_fill": f"with {chunks()}, {QUERY}, {bm25(30, 'run', zero=True)} select * from run",
    "contextual_bm25": f"with {chunks(contextual=True)}, {QUERY}, {bm25(10, 'run')} select * from run",
    "bm25_prf": f"""
        with {chunks()}, {QUERY}, {index()}, {QT}, {CS},
        pool as (select query_id, doc_id, chunk_idx, row_number() over (partition by query_id order by round(score, 6) desc, doc_id, chunk_idx) as rn from cs qualify rn <= 100),
        terms as (select query_id, doc_id, chunk_idx, rn, dl, term, tf from pool join post using (doc_id, chunk_idx)),
        g as (select query_id, term, sum(tf * idf) as w from terms join idf2 using (term) where rn <= 5 and length(term) >= 3 and (query_id, term) not in (select (query_id, term) from qt) group by all),
        gr as (select query_id, term, round(w / max(w) over (partition by query_id), 9) as w, row_number() over (partition by query_id order by w desc, term) as rn from g),
        wt as (select query_id, term, 1.0 as w from qt union all select query_id, term, 0.75 * w from gr where rn <= 10),
        sc as (select query_id, doc_id, chunk_idx, coalesce(sum(w * idf * {WEIGHT}), 0.0) as score from terms left join wt using (query_id, term) left join idf2 using (term), st group by all),
        ds as (select query_id, doc_id, max(score) as score from sc group by all) {top('ds', 10)}""",
    "dense_precomputed_topk": f"with s as (select q.vec_id as query_id, d.vec_id as doc_id, list_dot_product(q.embedding::double[], d.embedding::double[]) as score from embeddings q cross join embeddings d where q.vec_id % 50 = 0) {top('s', 10, 5)}",
    "l2_normalize": "select vec_id, 1.0 as norm, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first from embeddings",
    "hash_encode": f"with v as ({places('benchmark', 'item_id', 'text')}) select item_id, b as dim, round(x / sqrt(sum(x * x) over (partition by item_id)), 6) as x from v",
    "naive_dense": f"with {chunks()}, {QUERY}, {dense(10, 'run')} select * from run",
    "hyde": f"with {chunks()}, q as (select item_id as query_id, {hypothetical('text')} as text from benchmark), {dense(10, 'run')} select * from run",
    "contextual_dense": f"with {chunks(contextual=True)}, {QUERY}, {dense(10, 'run')} select * from run",
    "hybrid_rag": f"with {chunks()}, {QUERY}, {bm25(30, 'ra', zero=True)}, {dense(30, 'rb')}, {rrf('ra', 'rb')}",
    "contextual_hybrid": f"with {chunks(contextual=True)}, {QUERY}, {bm25(30, 'ra', zero=True)}, {dense(30, 'rb')}, {rrf('rb', 'ra')}",
    "splade": f"with {chunks()}, {QUERY}, {sparse(10, 'run')} select * from run",
    "splade_hybrid": f"with {chunks()}, {QUERY}, {sparse(30, 'ra')}, {dense(30, 'rb')}, {rrf('ra', 'rb')}",
    "agentic_multihop": f"with {chunks()}, p as (select item_id as query_id, unnest({decomposed('text')}) as text, generate_subscripts({decomposed('text')}, 1) as part from benchmark), q as (select query_id || '::' || part as query_id, text from p), {dense(10, 'r')}, s as (select cast(split_part(query_id, '::', 1) as bigint) as query_id, doc_id, sum(score) as score from r group by all) {top('s', 10)}",
    "two_stage_dense": f"with {chunks()}, {QUERY}, {dense(100, 'r')}, s as (select r.query_id, r.doc_id, case when len(list_distinct({tokens('q.text')})) > 0 then len(list_intersect(list_distinct({tokens('q.text')}), list_distinct({tokens(f"substr({strip(chr(39) + ' ' + chr(39) + ' || d.text')}, 1, 2048)")}))) / len(list_distinct({tokens('q.text')})) else 0.0 end as score from r join q using (query_id) join docs d using (doc_id)) {top('s', 10)}",
    "expansion_terms": f"with w as (select item_id, term, round(ln(1 + count(*)), 6) as weight from (select item_id, unnest({tokens('text')}) as term from benchmark) group by item_id, term) select item_id, term, weight, cast(rank as int) as rank from (select *, row_number() over (partition by item_id order by weight desc, term) as rank from w) where rank <= 5",
    "max_pool": "select vec_id % 7 as query_id, vec_id // 8 as doc_id, round(max(embedding[1]::double), 6) as score from embeddings group by all",
    "rrf": f"with v as (select vec_id % 5 as query_id, vec_id // 5 as doc_id, embedding[1]::double as a, embedding[2]::double as b from embeddings), va as (select query_id, doc_id, a as score from v), vb as (select query_id, doc_id, b as score from v), ra as ({top('va', 20)}), rb as ({top('vb', 20)}), {rrf('ra', 'rb')}",
    "maxsim_topk": f"with {TOKENS}, {maxsim('d', 'ms')} {top('ms', 10, 5)}",
    "maxsim_masked": f"with {TOKENS}, dm as (select * from d where tok_idx % 2 = 1), {maxsim('dm', 'ms')} {top('ms', 10, 5)}",
    "late_chunking_pool": "with t as (select vec_id // 50 as doc_id, vec_id % 50 as tok_idx, embedding::double[] as emb from embeddings), n as (select *, max(tok_idx) over (partition by doc_id) as n from t), u as (select doc_id, cast((tok_idx - 1) // 16 as int) as chunk_idx, unnest(emb) as x, cast(generate_subscripts(emb, 1) - 1 as int) as dim from n where tok_idx > 0 and tok_idx < n) select doc_id, chunk_idx, dim, round(avg(x), 5) as x from u group by all",
    "assign_centroids": f"with {TOKENS}, {NEAR} select doc_id, tok_idx, centroid_id from dn where rn = 1",
    "shared_centroids": f"with {_approx(3, 4)} select query_id, doc_id, overlap from ov",
    "approx_maxsim": f"with {_approx(3, 2)} {top('ms', 3)}",
    "fidelity": f"with {_approx(3, 2)}, {maxsim('d', 'ex')}, a as ({top('ms', 3)}), e as ({top('ex', 3)}) select e.query_id, round(count(a.doc_id) / 3, 6) as fidelity from e left join a using (query_id, doc_id) group by all",
    "residual_codec_roundtrip": f"with {CODEC} select doc_id, tok_idx, round(list_sum(emb), 3) as total from b",
    "compressed_maxsim": f"with {CODEC}, cand as (select distinct query_id, doc_id from (select distinct doc_id, centroid_id from b) join (select distinct query_id, centroid_id from qn where rn <= 2) using (centroid_id)) , {maxsim('b', 'ms', 'cand')} {top('ms', 5, 4)}",
    "sim_graph": "with e as (select a.vec_id as src, b.vec_id as dst, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as w from embeddings a join embeddings b on a.vec_id <> b.vec_id), k as (select *, row_number() over (partition by src order by w desc, dst) as rn from e where w >= 0.25) select distinct least(src, dst) as src, greatest(src, dst) as dst, w from k where rn <= 5",
    "community_summary": f"with {DOCS}, s as (select doc_id, doc_id % 20 as label, case when contains(text, '. ') then split_part(text, '. ', 1) else substr(text, 1, 100) end as s from docs), r as (select *, row_number() over (partition by label order by doc_id) as rn from s) select label, count(*) as size, md5(string_agg(case when rn <= 5 then s end, ' ' order by doc_id)) as summary_md5 from r group by label",
    "community_expansion": f"with {chunks()}, {QUERY}, {dense(10, 'r')}, t as (select distinct query_id, doc_id % 97 as label from r where rank <= 3), m as (select distinct t.query_id, d.doc_id from t join docs d on d.doc_id % 97 = t.label), s as (select query_id, doc_id, score from r union all select query_id, doc_id, 0.3 from m where (query_id, doc_id) not in (select (query_id, doc_id) from r)) {top('s', 10)}",
    "tree_leaves": "select node_id, level from (select 'r' || r_regionkey as node_id, 2 as level from region union all select 'n' || n_nationkey, 1 from nation union all select 's' || s_suppkey, 0 from supplier) where node_id not in (select 'r' || n_regionkey from nation union all select 'n' || s_nationkey from supplier)",
    "tree_paths": "select 's' || s_suppkey as start, 's' || s_suppkey as node_id, 0 as step from supplier union all select 's' || s_suppkey, 'n' || s_nationkey, 1 from supplier union all select 's' || s_suppkey, 'r' || n_regionkey, 2 from supplier join nation on s_nationkey = n_nationkey",
    "ir_metrics_per_query": f"{_PAIR}, {QRELS}, {metrics('ra', (1, 3, 10), 'm')} select query_id, metric, k, round(value, 6) as value from m",
    "metrics_summary": f"{_PAIR}, {QRELS}, {metrics('ra', (1, 3, 5, 10), 'ma')}, {metrics('rb', (1, 3, 5, 10), 'mb')} select 'bm25' as pipeline, metric, k, round(round(avg(value), 5), 4) as value from ma group by metric, k union all select 'dense', metric, k, round(round(avg(value), 5), 4) from mb group by metric, k",
    "pairwise_diff": f"{_DIFF} select 'bm25' as pipeline_a, 'dense' as pipeline_b, query_id, round(diff, 5) as diff from df",
    "t_stat": f"{_DIFF} select 'bm25' as pipeline_a, 'dense' as pipeline_b, count(*) as n, round(avg(diff), 5) as mean_diff, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 4) as t from df",
    "bonferroni": "select n_name as pair, round(0.05 / count(*) over (), 8) as adjusted_alpha, n_nationkey / 1000.0 < 0.05 / count(*) over () as significant from nation",
    "spearman": f"{_PAIR}, b as (select ra.query_id, row_number() over (partition by ra.query_id order by ra.rank)::double as x, row_number() over (partition by ra.query_id order by rb.rank)::double as y from ra join rb using (query_id, doc_id)) select query_id, count(*) as n, round(corr(x, y), 6) as rho from b group by query_id having count(*) >= 3",
    "em_f1": f"with b as (select b.item_id, lower(b.text) as g, lower(a.text) as p from benchmark b left join benchmark a on a.item_id = b.item_id - 1), t as (select item_id, g, coalesce(p, '') as p, list_distinct({words('g')}) as gt, list_distinct({words("coalesce(p, '')")}) as pt from b) select item_id, case when len(gt) = 0 then (len(pt) = 0)::int::double else ({strip('p')} = {strip('g')})::int::double end as em, round(case when len(gt) = 0 then (len(pt) = 0)::int::double when len(gt) + len(pt) = 0 then 0 else 2.0 * len(list_intersect(gt, pt)) / (len(gt) + len(pt)) end, 6) as f1 from t",
    "latency_percentiles": "select event_type, round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(value, 0.95), 4) as p95, round(quantile_cont(value, 0.99), 4) as p99, count(*) as n from events group by event_type",
    "subsample_queries": "select item_id as query_id from benchmark order by md5(item_id || ':42'), item_id limit 10",
    "subsample_corpus_keep_judged": f"with {QRELS}, g as (select distinct doc_id from rel) select doc_id from g union all select doc_id from (select doc_id from documents where doc_id not in (select doc_id from g) order by md5(doc_id || ':42'), doc_id limit greatest(0, 100 - (select count(*) from g)))",
    "benchmark_run": f"with {chunks()}, {QUERY}, {QRELS}, {bm25(30, 'rz', zero=True)}, rb as ({top('ds', 10)}), {dense(30, 'rd')}, f as (select query_id, doc_id, sum(1.0 / (60 + rank)) as score from (select query_id, doc_id, rank from rz union all select query_id, doc_id, rank from rd) group by all), rh as ({top('f', 10)}), rn as (select * from rd where rank <= 10), {metrics('rb', (1, 3, 5, 10, 100), 'ma')}, {metrics('rn', (1, 3, 5, 10, 100), 'mb')}, {metrics('rh', (1, 3, 5, 10, 100), 'mc')} select pipeline, metric, k, round(avg(value), 5) as value from (select 'bm25' as pipeline, * from ma union all select 'naive_dense', * from mb union all select 'hybrid_rag', * from mc) group by all",
}

_LATE = f"with {DOCS}, {QUERY}, {token_vectors('docs', 'doc_id', strip("' ' || text"), 'd')}, {token_vectors('q', 'query_id', 'text', 'q')}"
#: Windows without a place in common have product 0; so has a window that is zero itself.
ORACLES["late_interaction"] = f"""{_LATE},
    dot as (select qp.w as qw, dp.w as dw, sum(qp.x * dp.x) as s from qp join dp using (b) group by all),
    dd as (select distinct doc_id, w from dw), dn as (select doc_id, count(*) as n from dd group by all),
    mx as (select query_id, i, doc_id, max(s) as m, count(*) as hit from qw join dot on qw.w = dot.qw join dd on dd.w = dot.dw group by all),
    ms as (select query_id, doc_id, sum(case when hit < n then greatest(m, 0.0) else m end) as score from mx join dn using (doc_id) group by all)
    {top('ms', 10)}"""
ORACLES["late_chunking"] = f"""{_LATE},
    dc as (select doc_id, (i - 2) // 128 as c, b, sum(x) as x from dw join dp using (w) where i > 1 and i < n group by all),
    dn as (select doc_id, (i - 2) // 128 as c, count(*) as n from dw where i > 1 and i < n group by all),
    qc as (select query_id, b, sum(x) / any_value(n) as x from qw join qp using (w) group by query_id, b),
    sc as (select query_id, doc_id, c, sum(qc.x * dc.x / dn.n) as s from dc join dn using (doc_id, c) join qc using (b) group by all),
    ms as (select query_id, doc_id, max(round(s, 9)) as score from sc group by all)
    {top('ms', 10)}"""
_CONTEXT = "(select r.query_id, string_agg(d.text, ' ' order by r.rank) as context from r0 r join docs d using (doc_id) group by r.query_id)"
ORACLES["reflection"] = f"""with {chunks()}, {QUERY}, {dense(10, 'r0')},
    j as (select q.query_id, q.text, {coverage('q.text', 'c.context')} as cov from q left join {_CONTEXT} c using (query_id)),
    q2 as (select query_id, {broaden('text')} as text from j where cov < 0.5), {second(dense(10, 'r1', 'q2'))},
    fs as (select query_id, doc_id, min_by(score, rnd) as score from (select query_id, doc_id, score, 0 as rnd from r0 union all select query_id, doc_id, score, 1 from r1) group by all)
    {top('fs', 10)}"""
_PICKED = "row_number() over (partition by query_id order by md5(query_id || ':' || doc_id || ':42'), doc_id) as pn"
_TRIPLES = """pos as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) as pn from rel qualify pn <= 3),
    neg as (select query_id, doc_id as negative_id, {picked} from cand),
    cut as (select doc_id, substr({text}, 1, 1000) as t from docs)
    select pos.query_id, pos.doc_id, negative_id, md5(q.text || '|' || a.t || '|' || b.t) as triple_md5 from pos join neg using (query_id, pn) join cut a on a.doc_id = pos.doc_id join cut b on b.doc_id = negative_id join q on q.query_id = pos.query_id order by 1, 2 limit 10000"""
_TRIPLES = _TRIPLES.format(picked=_PICKED, text=strip("' ' || text"))
ORACLES["triples_random_negative"] = f"""with {DOCS}, {QUERY}, {QRELS},
    pool as (select doc_id from docs order by md5(doc_id || ':42'), doc_id limit (select coalesce(max(n), 0) + 3 from (select count(*) as n from rel group by query_id))),
    cand as (select query_id, doc_id from (select distinct query_id from rel) cross join pool where (query_id, doc_id) not in (select (query_id, doc_id) from rel)), {_TRIPLES}"""
ORACLES["triples_hard_negative"] = f"""with {DOCS}, {QUERY}, {QRELS},
    tok as (select doc_id, {words("lower(' ' || text)")} as t from docs), st as (select count(*)::double as n, avg(len(t)) as avgdl from tok),
    post as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from tok) group by all),
    raw as (select term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post, st group by term),
    idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
    qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({words('lower(text)')}) as term from q) group by all),
    sc as (select query_id, doc_id, round(sum(qtf * idf * {WEIGHT}), 6) as score from qt join post using (term) join idf using (term), st group by all),
    cand as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rn from sc where (query_id, doc_id) not in (select (query_id, doc_id) from rel) qualify rn <= 50), {_TRIPLES}"""
#: Suppliers below nations below regions, with two token vectors for every node.
_TREE = """
    nodes as (select 's' || s_suppkey as node_id, 0 as level, s_suppkey as doc_id, 2 * s_suppkey as v from supplier union all select 'n' || n_nationkey, 1, null, 300 + 2 * n_nationkey from nation union all select 'r' || r_regionkey, 2, null, 400 + 2 * r_regionkey from region),
    tk as (select node_id, vec_id - v as tok_idx, embedding::double[] as emb from nodes join embeddings on vec_id in (v, v + 1)),
    edges as (select 'r' || n_regionkey as parent_id, 'n' || n_nationkey as child_id from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier),
    below as (select 's' || s_suppkey as node_id, s_suppkey as doc_id from supplier union all select 'n' || s_nationkey, s_suppkey from supplier union all select 'r' || n_regionkey, s_suppkey from supplier join nation on s_nationkey = n_nationkey),
    ns as (select query_id, node_id, round(sum(m), 6) as score from (select q.query_id, q.tok_idx, node_id, max(list_cosine_similarity(q.emb, tk.emb)) as m from q cross join tk group by all) group by all)"""
_BEST = "row_number() over (partition by query_id order by score desc, node_id) as rn"
_DOWN = "ds as (select query_id, doc_id, max(score) as score from best join below using (node_id) group by all)"
ORACLES["tree_late_collapsed"] = f"with {TOKENS}, {_TREE}, best as (select *, {_BEST} from ns qualify rn <= 10), {_DOWN} {top('ds', 10)}"
_LEVEL = "k{i} as (select *, {best} from ns where (query_id, node_id) in (select (k.query_id, e.child_id) from k{up} k join edges e on e.parent_id = k.node_id) qualify rn <= 10)"
ORACLES["tree_late_traversal"] = f"""with {TOKENS}, {_TREE}, k2 as (select *, {_BEST} from ns where node_id like 'r%' qualify rn <= 10), {_LEVEL.format(i=1, up=2, best=_BEST)}, {_LEVEL.format(i=0, up=1, best=_BEST)},
    kept as (select query_id, node_id, score from k2 union all select query_id, node_id, score from k1 union all select query_id, node_id, score from k0),
    best as (select *, {_BEST} from kept qualify rn <= 10), {_DOWN} {top('ds', 10)}"""
ORACLES["joined_chunks"] = f"with {chunks(100, 0)} select doc_id, md5(string_agg(text, ' ' order by chunk_idx)) as text_md5 from chunks group by doc_id"
ORACLES["sparse_activation"] = "select vec_id, dim, round(ln(1 + greatest(x, 0)), 6) as weight from (select vec_id, unnest(embedding::double[]) as x, cast(generate_subscripts(embedding, 1) - 1 as int) as dim from embeddings) where x > 0"
for _how, _f in _POOL.items():
    ORACLES[f"pool_{_how}"] = f"with {TOKENS}, u as (select doc_id, tok_idx, unnest(emb) as x, cast(generate_subscripts(emb, 1) - 1 as int) as dim from d) select doc_id, dim, round({_f}, 5) as x from u group by all"
