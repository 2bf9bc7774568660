"""Chunking, embedding, retrieval and prompt queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors
from ..operators import chunks, inverted_file, neighbours, postings, retrieval as ops
from ..sources import vector_store
from ..sources.scratch import scratch_path, shared_folder
from ..sources.tables import derived, table
from . import dimensions as dim
from . import sql_text as q
from .registry import query


def chunks_sql(source: str, id_column: str = "doc_id", column: str = "text") -> str:
    return f"""
    chunk_starts as (
      select {id_column}, {column}, unnest(range(
        greatest(cast(ceil((length({column}) - 200) / 800.0) as bigint), 1))) as chunk_ix
      from {source} where length({column}) > 0),
    chunks as (
      select * from (
        select {id_column}, cast(chunk_ix as integer) as chunk_ix,
          {q.strip(f'substring({column}, chunk_ix * 800 + 1, 1000)')} as chunk_text
        from chunk_starts) where chunk_text <> '')
    """


@query("chunk_windows", f"with {chunks_sql('documents')} select * from chunks")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.chunk_windows(docs, "text")


# Every character position knows whether a chunk may be cut before it; windows then
# follow from one position to the next, packs from one paragraph to the next.
_PARAGRAPHS_SQL = f"""with recursive
pieces as (
  select doc_id, unnest(p) as piece, unnest(range(len(p))) as i
  from (select doc_id, string_split(text, chr(10) || chr(10)) as p from paragraph_docs)),
placed as (
  select doc_id, i, length(piece) + case when i = 0 then 0 else 2 end as n, sum(length(piece) +
    case when i = 0 then 0 else 2 end) over (partition by doc_id order by i) as e from pieces),
spans as (
  select doc_id, i, e - n as s, e, i - row_number() over (
    partition by doc_id, n < 1000 order by i) as run, n < 1000 as short from placed where n > 0),
packs as (
  select doc_id, run, min(i) as first, 0 as step from spans where short group by doc_id, run
  union all
  select c.doc_id, c.run, min(n.i) as first, c.step + 1 from (
    select p.doc_id, p.run, p.first, p.step, max(l.i) as last, max(l.e) as done
    from packs p join spans f on f.doc_id = p.doc_id and f.short and f.run = p.run and f.i = p.first
    join spans l on l.doc_id = p.doc_id and l.short and l.run = p.run and l.i >= p.first
      and l.e - f.s <= 1000
    group by all) as c
  join spans d on d.doc_id = c.doc_id and d.short and d.run = c.run and d.i = c.last + 1
  join spans n on n.doc_id = c.doc_id and n.short and n.run = c.run and n.i > c.first
    and c.done - n.s <= 200 and d.e - n.s <= 1000
  group by c.doc_id, c.run, c.step),
packed as (
  select p.doc_id, f.s as pos, max(l.e) as stop
  from packs p join spans f on f.doc_id = p.doc_id and f.short and f.run = p.run and f.i = p.first
  join spans l on l.doc_id = p.doc_id and l.short and l.run = p.run and l.i >= p.first
    and l.e - f.s <= 1000
  group by p.doc_id, f.s),
places as (
  select s.doc_id, s.i, s.s, s.e, unnest(range(s.s::bigint, s.e::bigint + 1)) as p, unnest(
    list_append(string_split(substring(text, s.s::bigint + 1, (s.e - s.s)::bigint), ''), '')) as ch
  from spans s join paragraph_docs using (doc_id) where not short),
cuts as (
  select doc_id, i, p, s, e, case when p in (s, e) or ch <> chr(10)
    then p end as cut from places),
known as (
  select doc_id, i, p, s, e, cut,
    min(cut) over (partition by doc_id, i order by p rows between current row and unbounded following) as up,
    min(cut) over (partition by doc_id, i order by p rows between 1 following and unbounded following) as following,
    max(cut) over (partition by doc_id, i order by p rows between current row and 1000 following) as stop
  from cuts),
moves as (
  select a.doc_id, a.i, a.p as pos, a.stop, t.up as next
  from known a join known b on b.doc_id = a.doc_id and b.i = a.i and b.p = a.stop
  left join known t on t.doc_id = a.doc_id and t.i = a.i
    and t.p = greatest(a.stop - 200, b.following - 1000, a.p + 1) and a.stop < a.e
  where a.cut is not null),
windows as (
  select doc_id, i, pos, stop, next from moves where pos = (
    select s from spans where spans.doc_id = moves.doc_id and spans.i = moves.i)
  union all
  select m.doc_id, m.i, m.pos, m.stop, m.next from windows w join moves m
    on m.doc_id = w.doc_id and m.i = w.i and m.pos = w.next),
bounds as (
  select doc_id, pos, stop from packed union all select doc_id, pos, stop from windows),
chunks as (
  select doc_id, pos, {q.strip('substring(text, pos::bigint + 1, (stop - pos)::bigint)')} as chunk_text
  from bounds join paragraph_docs using (doc_id))
select doc_id, chunk_text, cast(row_number() over (
  partition by doc_id order by pos) - 1 as integer) as chunk_ix from chunks where chunk_text <> ''
"""


@query("chunk_paragraphs", _PARAGRAPHS_SQL, uses=("paragraph_docs",))
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_paragraphs(derived(spark, sf_dir, "paragraph_docs"), "doc_id", "text")


@query(
    "embed_hash",
    f"""with words as (select doc_id, unnest({q.tokens('text')}) as word from documents),
    counts as (
      select doc_id, ('0x' || substring(md5(word), 1, 8))::bigint % 256 as place, count(*) as n
      from words group by all),
    norms as (select doc_id, sqrt(sum(n * n)) as norm from counts group by doc_id)
    select doc_id, place::integer as place, round((n / norm)::float::double, 6) as weight
    from counts join norms using (doc_id)""",
)
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors' places that are not zero, one row each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places = ops.embed_hash(docs, "text").select("doc_id", F.posexplode("embedding").alias("place", "x"))
    return places.filter("x <> 0").select(
        "doc_id", "place", F.round(F.col("x").cast("double"), 6).alias("weight")
    )


@query(
    "embed_idf",
    f"""with words as (select doc_id, unnest({q.tokens('text')}) as word from documents),
    counts as (
      select doc_id, ('0x' || substring(md5(word), 1, 8))::bigint % 256 as place, count(*) as n
      from words group by all),
    rarity as (
      select place, ln(((select count(text) from documents) + 1.0) / (count(*) + 1.0)) + 1 as idf
      from counts group by place),
    weighted as (select doc_id, place, n * idf as w from counts join rarity using (place)),
    norms as (select doc_id, sqrt(sum(w * w)) as norm from weighted group by doc_id)
    select doc_id, place::integer as place, round((w / norm)::float::double, 5) as weight
    from weighted join norms using (doc_id)""",
)
def embed_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with words weighed by their rarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors_ = ops.embed_hash(docs, "text", idf=ops.fit_idf(docs, "text"))
    places = vectors_.select("doc_id", F.posexplode("embedding").alias("place", "x"))
    return places.filter("x <> 0").select(
        "doc_id", "place", F.round(F.col("x").cast("double"), 5).alias("weight")
    )


@query(
    "l2_normalize",
    """with parts as (
      select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
    norms as (select vec_id, sqrt(sum(x * x)) as norm from parts group by vec_id)
    select vec_id, round(sum(x / norm * i), 5) as weighted_sum,
      round(sqrt(sum(x / norm * (x / norm))), 6) as unit_norm, count(*) as dims
    from parts join norms using (vec_id) group by vec_id""",
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.l2_normalize("embedding").alias("u")
    )
    weighted = F.aggregate(
        F.transform("u", lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x
    )
    return unit.select(
        "vec_id",
        F.round(weighted, 5).alias("weighted_sum"),
        F.round(vectors.norm("u"), 6).alias("unit_norm"),
        F.size("u").cast("long").alias("dims"),
    )


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval request per label: its mean vector."""
    return ops.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")


def label_hits(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    return neighbours.nearest(
        label_queries(spark, sf_dir),
        table(spark, sf_dir, "embeddings") if index is None else index,
        query_columns=("label", "embedding"),
    )


_PARTS_SQL = """
parts as (
  select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i
  from embeddings),
means as (select label, i, avg(x) as m from parts group by label, i)
"""
_HITS_SQL = f"""{_PARTS_SQL},
distances as (
  select m.label as query_id, p.vec_id as item_id, round(sum((x - m) * (x - m)), 8) as distance
  from parts p join means m using (i) group by 1, 2),
hits as (
  select * from (
    select *, row_number() over (partition by query_id order by distance, item_id) as rank
    from distances) where rank <= 4)
"""


@query(
    "knn_l2",
    f"""with {_HITS_SQL} select query_id::bigint as query_id, item_id, distance,
      rank::integer as rank from hits""",
)
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_hits(spark, sf_dir).withColumn("distance", F.round("distance", 8))


@query(
    "cosine_filter",
    f"""with {_PARTS_SQL},
    alike as (
      select vec_id, p.label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) as similarity
      from parts p join means m on p.label = m.label and p.i = m.i group by 1, 2)
    select * from alike where similarity >= 0.1""",
)
def cosine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return ops.cosine_filter(items, label_queries(spark, sf_dir), "label", 0.1).select(
        "vec_id", "label", "similarity"
    )


_ITEMS_SQL = """
parts as (
  select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings)
"""
_UNIT_ITEMS_SQL = """
given as (
  select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
norms as (select vec_id, sqrt(sum(x * x)) as norm from given group by vec_id),
parts as (select vec_id, x / norm as x, i from given join norms using (vec_id))
"""
_PAIRS_SQL = """
distances as (
  select a.vec_id as query_id, b.vec_id as item_id, round(sum((a.x - b.x) * (a.x - b.x)), 8) as distance
  from parts a join parts b using (i) where a.vec_id <> b.vec_id group by 1, 2),
ranked as (
  select *, row_number() over (partition by query_id order by distance, item_id) as rank
  from distances)
"""


@query(
    "recommend_items",
    f"""with {_UNIT_ITEMS_SQL}, {_PAIRS_SQL} select query_id, item_id, 1 - distance / 2 as similarity,
      rank::integer as rank from ranked where rank <= 4""",
)
def recommend_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    unit = items.select("vec_id", vectors.l2_normalize("embedding").alias("embedding"))
    hits = neighbours.nearest(
        unit, unit, query_columns=("vec_id", "embedding"), skip_self=True
    )
    return hits.select(
        "query_id", "item_id", (1 - F.round("distance", 8) / 2).alias("similarity"), "rank"
    )


@query(
    "knn_join",
    f"""with {_ITEMS_SQL}, {_PAIRS_SQL} select query_id, item_id, distance,
      rank::integer as rank from ranked where rank <= 10""",
)
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large-by-large join: neither side is broadcast."""
    items = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(
        items,
        items,
        k=10,
        query_columns=("vec_id", "embedding"),
        skip_self=True,
        broadcast_values=1,
    ).withColumn("distance", F.round("distance", 8))


@query("knn_ivf")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large-by-large join, approximate: every item against a stored inverted file."""
    items, path = table(spark, sf_dir, "embeddings"), scratch_path(spark, "inverted-file")
    inverted_file.write_index(items, path, inverted_file.fit(items, "vec_id", "embedding"), "vec_id", "embedding")
    return inverted_file.search(items, path, 10, query_columns=("vec_id", "embedding"), skip_self=True)


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's chunk is the text of the document with its id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("chunk_text")
    )


_CONTEXT_SQL = f"""{_HITS_SQL},
contexts as (
  select query_id, string_agg(text, chr(10) || chr(10) order by rank) as context,
    count(*) as n_chunks
  from hits join documents on doc_id = item_id group by query_id)
"""


def contexts(spark: SparkSession, hits: DataFrame, chunks_: DataFrame) -> DataFrame:
    """Hits are written first: their size is then known, and Spark broadcasts them under its threshold."""
    path = scratch_path(spark, "hits")
    hits.write.parquet(path)
    return ops.retrieve_context(spark.read.parquet(path), chunks_)


@query(
    "retrieve_context",
    f"""with {_CONTEXT_SQL} select query_id::bigint as query_id, context, n_chunks::integer as n_chunks
    from contexts""",
)
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, label_hits(spark, sf_dir), embedded_chunks(spark, sf_dir))


_TEMPLATES_SQL = dim.sql_values(list(dim.TEMPLATES.items()), "templates", "force, template")
_FORCE_NAMES = [f"{f[1]} Force" for f in dim.FORCES]
_NAMES_SQL = dim.sql_values(
    [(i, f[0], f"{f[1]} Force") for i, f in enumerate(dim.FORCES)], "names", "ix, force, force_name"
)


@query(
    "answer_requests",
    f"""with {_CONTEXT_SQL}, {_TEMPLATES_SQL}, {_NAMES_SQL}
    select query_id::bigint as query_id, force, replace(template, '{{context}}', context)
      || chr(10) || 'Question: What of label ' || query_id || '?' as prompt
    from contexts join names on ix = query_id % 5 join templates using (force)""",
)
def answer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for questions asked of a stored index, opened by its name; the context is the index's own chunks."""
    index = stored_items(spark, sf_dir)
    hits = label_hits(spark, sf_dir, index)
    chunks_ = index.filter("chunk_text is not null").select(F.col("vec_id").alias("item_id"), "chunk_text")
    names = F.element_at(F.array(*map(F.lit, _FORCE_NAMES)), (F.col("query_id") % 5 + 1).cast("int"))
    question = F.concat(F.lit("What of label "), F.col("query_id").cast("string"), F.lit("?"))
    requests = contexts(spark, hits, chunks_).withColumns({"force_name": names, "question": question})
    templates = dim.templates(spark).withColumn("template", F.concat("template", F.lit("\nQuestion: {question}")))
    rendered = ops.render_prompt(requests, dim.forces(spark), templates, question="question")
    return rendered.select("query_id", "force", "prompt")


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of a folder's items with the text each stands for; written when first asked for."""
    path, name = f"{shared_folder(spark)}/item-index", hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    try:
        return vector_store.load(spark, path, name)
    except vector_store.MissingIndex:
        texts = embedded_chunks(spark, sf_dir).withColumnRenamed("item_id", "vec_id")
        items = table(spark, sf_dir, "embeddings").join(texts, "vec_id", "left").withColumn("index_name", F.lit(name))
        vector_store.store(items, path)
        return vector_store.load(spark, path, name)


@query(
    "render_prompt",
    f"""with {_TEMPLATES_SQL}
    select doc_id, force, replace(template, '{{context}}', text) as prompt
    from notes join templates using (force)""",
    uses=("notes",),
)
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = derived(spark, sf_dir, "notes").select(
        "doc_id", F.col("force").alias("force_name"), F.col("text").alias("context")
    )
    rendered = ops.render_prompt(notes, dim.forces(spark), dim.templates(spark))
    return rendered.select("doc_id", "force", "prompt")


@query(
    "render_meta_prompt",
    f"""with {dim.sql_values([(f[3],) for f in dim.FORCES], 'f', 'porter_force')},
    {dim.sql_values([(dim.META_TEMPLATE,)], 't', 'template')}
    select idea_id, porter_force, replace(replace(template, '{{project_idea}}', idea),
      '{{porter_force}}', porter_force) as prompt
    from responses cross join f cross join t""",
    uses=("responses",),
)
def render_meta_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    ideas = derived(spark, sf_dir, "responses").select("idea_id", "idea")
    prompts = ops.render_meta_prompt(ideas, [f[3] for f in dim.FORCES], dim.META_TEMPLATE)
    return prompts.select("idea_id", "porter_force", "prompt")


_SEARCHES_SQL = dim.sql_values(dim.SEARCHES, "searches", "request_id, force, keywords")


_SEARCH_SQL = f"""with {_SEARCHES_SQL},
    terms as (
      select distinct request_id, unnest({q.tokens('keywords')}) as term from searches),
    words as (select doc_id, {q.tokens('text')} as t from documents),
    size as (select count(*) as n, avg(len(t)) as mean_length from words),
    matches as (
      select doc_id, len(t) as length, term, len(list_filter(t, lambda x: x = term)) as tf
      from words join (select distinct term from terms) on list_contains(t, term)),
    frequency as (select term, count(*) as df from matches group by term),
    scored as (
      select request_id, doc_id, round(sum(
        ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) as score
      from matches join frequency using (term) join terms using (term) cross join size
      group by request_id, doc_id)
    select request_id::bigint as request_id, doc_id, score, rank::integer as rank from (
      select *, row_number() over (partition by request_id order by score desc, doc_id) as rank
      from scored) where rank <= 50"""


@query("search_topn", _SEARCH_SQL)
def search_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = dim.local_table(spark, "request_id force keywords", dim.SEARCHES)
    return ops.bm25(
        table(spark, sf_dir, "documents"), ops.query_terms(searches, "keywords"), "doc_id", "text"
    )


@query("search_stored", _SEARCH_SQL)
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over a stored index, of which only the buckets of its terms are read."""
    path = scratch_path(spark, "postings")
    postings.write_index(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    searches = dim.local_table(spark, "request_id force keywords", dim.SEARCHES)
    return postings.search(spark, path, ops.query_terms(searches, "keywords"), "doc_id")


@query(
    "keyword_extract",
    f"""with words as (select doc_id, unnest({q.tokens('text')}) as term from documents),
    counts as (select doc_id, term, count(*) as tf from words group by all),
    frequency as (select term, count(*) as df from counts group by term),
    scored as (
      select doc_id, term,
        round(tf * ln(((select count(*) from documents) + 1.0) / (df + 1.0)), 6) as score
      from counts join frequency using (term))
    select doc_id, term, score, rank::integer as rank from (
      select *, row_number() over (partition by doc_id order by score desc, term) as rank
      from scored) where rank <= 5""",
)
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_extract(table(spark, sf_dir, "documents"), "doc_id", "text")
