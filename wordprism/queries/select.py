"""Selections of the linked views and their combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordprism.operators import regions, select, views
from wordprism.plans.tables import stored
from wordprism.queries.base import plane, spans, table, texts
from wordprism.registry import cte, query

POLYGON = [(-0.25, -0.25), (0.25, -0.3), (0.05, 0.025), (0.275, 0.325), (-0.225, 0.2)]
LINKED = "fr"

_EDGES = ", ".join(
    f"({ax}::double, {ay}::double, {bx}::double, {by}::double)" for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[1:] + POLYGON[:1])
)
cte(
    "inside",
    f"""
  select text_id, any_value(label) as label, any_value(x) as x, any_value(y) as y
  from plane, (values {_EDGES}) e(px, py, qx, qy)
  group by text_id
  having bool_or((qx - px) * (y - py) = (qy - py) * (x - px) and x between least(px, qx) and greatest(px, qx)
                 and y between least(py, qy) and greatest(py, qy))
    or count(*) filter ((py > y) <> (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px) % 2 = 1""",
)


def inside(spark, sf_dir):
    return select.lasso(plane(spark, sf_dir), POLYGON)


@query("sel_lasso", "select text_id, x, y, label from inside")
def sel_lasso(spark, sf_dir):
    return inside(spark, sf_dir)


RINGS = 24  # polygons around the middle of each class
_SHAPE = ((-1.0, -0.5), (0.25, -1.0), (0.125, 0.0), (1.0, 0.25), (-0.25, 1.0))


@query(
    "sel_lasso_many",
    f"""
  with box as (select label, avg(x) as mx, avg(y) as my, max(x) - min(x) as w, max(y) - min(y) as h from plane group by label),
  ring as (select *, unnest(range(1, {RINGS + 1})) as k from box),
  corner as (
    select label, k, i, mx + w * k / {RINGS}.0::double * sx as px, my + h * k / {RINGS}.0::double * sy as py
    from ring, (values {", ".join(f"({i}, {a}::double, {b}::double)" for i, (a, b) in enumerate(_SHAPE))}) v(i, sx, sy)),
  edge as (
    select a.label || ':' || a.k as polygon, a.label as own, a.px, a.py, b.px as qx, b.py as qy
    from corner a join corner b on a.label = b.label and a.k = b.k and b.i = (a.i + 1) % {len(_SHAPE)}),
  hit as (
    select polygon, own, text_id, any_value(label) as label from plane, edge group by polygon, own, text_id
    having bool_or((qx - px) * (y - py) = (qy - py) * (x - px) and x between least(px, qx) and greatest(px, qx) and y between least(py, qy) and greatest(py, qy))
      or count(*) filter ((py > y) <> (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px) % 2 = 1)
  select p.polygon, count(text_id) as n, count(text_id) filter (label = p.own) as n_own
  from (select distinct polygon, own from edge) p left join hit using (polygon, own) group by 1""",
)
def sel_lasso_many(spark, sf_dir):
    """Points, and points of the own class, inside each of a set of polygons around the middle of every class."""
    rows = plane(spark, sf_dir)
    box = rows.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    rings = box.select("*", F.explode(F.sequence(F.lit(1), F.lit(RINGS))).alias("k"))
    size = lambda c: F.col(c) * F.col("k") / float(RINGS)
    corners = F.array(*[F.struct((F.col("mx") + size("w") * a).alias("x"), (F.col("my") + size("h") * b).alias("y")) for a, b in _SHAPE])
    polygons = stored(rings.select(F.concat_ws(":", "label", "k").alias("polygon"), F.col("label").alias("own"), corners.alias("corners")), "polygons")
    found = regions.in_polygons(rows.select("label", "x", "y"), polygons).groupBy("polygon", "label").agg(F.count(F.lit(1)).alias("m"))
    joined = polygons.select("polygon", "own").join(found, "polygon", "left")
    return joined.groupBy("polygon").agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("label") == F.col("own"), F.col("m"))), F.lit(0)).alias("n_own")
    )


@query("sel_class", "select text_id, label from texts where label in ('de', 'es', 'fr')")
def sel_class(spark, sf_dir):
    return select.by_class(texts(spark, sf_dir), ("de", "es", "fr")).select("text_id", "label")


# the word selected is the most frequent one
cte("top_word", "select token from freq order by frequency desc, token desc limit 1")
cte("word_hits", 'select text_id, token, "start", "end" from ctok where token = (select token from top_word)')


def top_word(rows):
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.orderBy(F.desc("frequency"), F.desc("token")).first()["token"]


def word_hits(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return select.by_word(rows, top_word(rows)).select("text_id", "token", "start", "end")


@query("sel_word", "select * from word_hits")
def sel_word(spark, sf_dir):
    return word_hits(spark, sf_dir)


def _marked(spark, sf_dir, column):
    rows = table(spark, sf_dir, "labels").where(F.col(column) == 1)
    return rows.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("text_id"))


cte(
    "toggled",
    """
  select text_id from (
    select text_id from (select 'doc_' || doc_id as text_id from labels where toxic = 1)
    union all select 'doc_' || doc_id from labels where quality = 1)
  group by text_id having count(*) % 2 = 1""",
)


def toggled(spark, sf_dir):
    """Toxic texts are listed, then all good ones are clicked."""
    return select.toggle_texts(_marked(spark, sf_dir, "toxic"), _marked(spark, sf_dir, "quality"))


@query("sel_text", "select text_id from toggled")
def sel_text(spark, sf_dir):
    return toggled(spark, sf_dir)


# Links of a simple attribution: how often a token occurs in a class beyond half of its occurrences.
cte(
    "share",
    """
  select label as "class", token, n * (n::double / sum(n) over (partition by token) - 0.5) as score from (
    select label, token, count(*) as n from ctok where token in (select token from kept) group by 1, 2)""",
)
cte(
    "links",
    """
  select "class", token, score as value from share
  where score > 0 and "class" in (select "class" from share group by 1 having min(score) <> max(score))
  qualify row_number() over (partition by "class" order by score desc, token) <= 5""",
)


def share(spark, sf_dir):
    """``class, token, score`` and the occurrences it was made from."""
    from wordprism.operators import stats

    rows = stored(spans(spark, sf_dir), "spans")
    # one row per class and token before anything is joined on the token
    counts = stored(rows.groupBy(F.col("label").alias("class"), "token").agg(F.count(F.lit(1)).alias("n")), "counts")
    kept = stats.iqr_filter(counts.groupBy("token").agg(F.sum("n").alias("frequency")), stats.LOWEST_FREQUENCY)
    score = F.col("n") * (F.col("n") / F.col("frequency") - 0.5)
    return counts.join(kept, "token").select("class", "token", score.alias("score")), rows


def links(spark, sf_dir):
    scores, rows = share(spark, sf_dir)
    return views.sankey_links(scores), rows


@query("sel_sankey_class", f"""select text_id, label, pos, token, "start", "end" from ctok
    where label = '{LINKED}' and token in (select token from links where "class" = '{LINKED}')""")
def sel_sankey_class(spark, sf_dir):
    found, rows = links(spark, sf_dir)
    return select.linked_by_class(found, rows, LINKED).select("text_id", "label", "pos", "token", "start", "end")


cte("top_link", "select token from links order by token limit 1")


@query("sel_sankey_token", """select text_id, label, pos, token, "start", "end" from ctok
    where token = (select token from top_link) and label in (
      select "class" from links where token = (select token from top_link))""")
def sel_sankey_token(spark, sf_dir):
    found, rows = links(spark, sf_dir)
    found = stored(found, "links")
    token = found.orderBy("token").first()["token"]
    return select.linked_by_token(found, rows, token).select("text_id", "label", "pos", "token", "start", "end")


cte(
    "selection",
    f"""
  select 'lasso' as view, text_id, null::int as "start", null::int as "end" from inside
  union all select 'class', text_id, null, null from texts where label in ('de', 'es', 'fr')
  union all select 'word', text_id, "start", "end" from word_hits
  union all select 'text', text_id, null, null from toggled
  union all select 'explanation', text_id, "start", "end" from ctok
    where label = '{LINKED}' and token in (select token from links where "class" = '{LINKED}')""",
)


def selection(spark, sf_dir, linked=None):
    """One selection in every view; ``linked`` are links that are at hand already."""
    found, rows = linked or links(spark, sf_dir)
    return select.union(
        select.as_selection(inside(spark, sf_dir), "lasso"),
        select.as_selection(select.by_class(texts(spark, sf_dir), ("de", "es", "fr")), "class"),
        select.as_selection(select.by_word(rows, top_word(rows)), "word"),
        select.as_selection(toggled(spark, sf_dir), "text"),
        select.as_selection(select.linked_by_class(found, rows, LINKED), "explanation"),
    )


@query("sel_union_projection", "select view, text_id from selection where view in ('lasso', 'class')")
def sel_union_projection(spark, sf_dir):
    return select.projection_entries(selection(spark, sf_dir))


# The fold in SQL: presence of the 32 view masks, folded over sets of masks.
_FOLD = """
  with masks as (select text_id, bit_or((case view when 'lasso' then 1 when 'class' then 2 when 'word' then 4
                   when 'text' then 8 else 16 end)) as mask from selection group by text_id),
  s0 as (select list(distinct mask) as present from masks),
  v as (select present, list_filter(present, lambda m: m & 1 > 0) as v1, list_filter(present, lambda m: m & 2 > 0) as v2,
          list_filter(present, lambda m: m & 4 > 0) as v3, list_filter(present, lambda m: m & 8 > 0) as v4,
          list_filter(present, lambda m: m & 16 > 0) as v5 from s0),
  a2 as (select *, case when len(v1) = 0 then v2 when len(v2) = 0 then v1 else list_intersect(v1, v2) end as a from v),
  a3 as (select * exclude (a), case when len(a) = 0 then v3 when len(v3) = 0 then a else list_intersect(a, v3) end as a from a2),
  a4 as (select * exclude (a), case when len(a) = 0 then v4 when len(v4) = 0 then a else list_intersect(a, v4) end as a from a3),
  a5 as (select * exclude (a), case when len(a) = 0 then v5 when len(v5) = 0 then a else list_intersect(a, v5) end as a from a4)
"""
cte("chosen", _FOLD + " select text_id from masks, a5 where list_contains(a, mask)")


def chosen(spark, sf_dir, linked=None):
    rows = stored(selection(spark, sf_dir, linked), "selection")
    return select.intersect(rows), rows


@query("sel_intersect", "select text_id from chosen")
def sel_intersect(spark, sf_dir):
    return chosen(spark, sf_dir)[0]


@query(
    "sel_positions",
    """select view, text_id, "start", "end" from selection
       where view in ('word', 'explanation') and text_id in (select text_id from chosen)""",
)
def sel_positions(spark, sf_dir):
    ids, rows = chosen(spark, sf_dir)
    return select.positions(rows, ids).select("view", "text_id", "start", "end")


@query(
    "sel_count",
    """select 'all' as but, count(*) as n from selection
       union all select 'projection', count(*) from selection where view not in ('lasso', 'class')
       union all select 'word', count(*) from selection where view <> 'word'""",
)
def sel_count(spark, sf_dir):
    rows = stored(selection(spark, sf_dir), "selection")
    counts = [select.count_entries(rows, but).select(F.lit(but or "all").alias("but"), "n") for but in (None, "projection", "word")]
    return select.union(*counts)


@query(
    "sel_mark_points",
    """select p.text_id, p.x, p.y, t.label,
         (exists (select 1 from chosen) and p.text_id not in (select text_id from chosen)) or t.label not in ('fr') as unselected
       from plane p join texts t using (text_id)""",
)
def sel_mark_points(spark, sf_dir):
    rows = plane(spark, sf_dir).drop("label").join(texts(spark, sf_dir).select("text_id", "label"), "text_id")
    return select.mark_points(rows, chosen(spark, sf_dir)[0], ("fr",)).select("text_id", "x", "y", "label", "unselected")


@query(
    "sel_sankey_count",
    """
    with hit as (select distinct token from ctok where text_id in (select text_id from chosen))
    select 'class' as type, "class" as node, count(*) filter (token in (select token from hit)) as n from links group by "class"
    union all select distinct 'token', token, case when token in (select token from hit) then 1 else 0 end from links""",
)
def sel_sankey_count(spark, sf_dir):
    found, rows = links(spark, sf_dir)
    return select.link_counts(found, rows, chosen(spark, sf_dir, (found, rows))[0])


@query("sel_clear", "select view, text_id, \"start\", \"end\" from selection where view <> 'word'")
def sel_clear(spark, sf_dir):
    return select.clear(selection(spark, sf_dir), "word")


@query("sel_labels", "select text_id, label from texts where text_id in (select text_id from chosen)")
def sel_labels(spark, sf_dir):
    return select.selected_labels(texts(spark, sf_dir), chosen(spark, sf_dir)[0])
