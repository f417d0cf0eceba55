"""Splitting and merging of regions, on frames of several sizes."""

from pyspark.sql import functions as F

from ..operators import regions as rg
from .raster_queries import comp
from .registry import query

ITEM = ["image_id", "item"]
# a raster's cell becomes k x k pixels, k = 4, 5 or 6 by image: frames of 32, 40 and 48 pixels
BLOCKS = """, bl AS (SELECT image_id, y, x, v, 4+image_id%3 AS k, CAST(least(255,greatest(0,floor((v+0.5)*255))) AS BIGINT) AS b FROM raster)"""
REACH = {0: 6, 1: 6, 2: 6, 3: 5, 4: 4, 5: 2, 6: 0}  # of an ellipse of radius 3, applied twice


def blocks(t):
    b = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v") + 0.5) * 255))).cast("bigint")
    return t.raster.select("image_id", "y", "x", "v", (4 + F.col("image_id") % 3).cast("int").alias("k"), b.alias("b"))


def _rows():
    """Rows of pixels that a row of cells becomes."""
    return F.sequence(F.col("y") * F.col("k"), F.col("y") * F.col("k") + F.col("k") - 1).cast("array<int>")


def heat(t, value="b", name="v"):
    """Arrays of pixel values a row of the frame."""
    cells = F.array_sort(F.collect_list(F.struct("x", F.col(value).cast("double").alias("b"))))
    each = F.transform("cells", lambda c: F.transform(F.sequence(F.lit(1), F.col("k")), lambda _: c["b"]))
    rows = blocks(t).groupBy("image_id", "k", "y").agg(cells.alias("cells")).withColumn("wide", F.flatten(each))
    return rows.select("image_id", F.explode(_rows()).alias("y"), F.col("wide").alias(name))


def block_rows(cells):
    """Rows of regions given as cells (image_id, item, y, x, k)."""
    g = cells.groupBy(*ITEM, "k", "y").agg(F.collect_set("x").alias("xs"))
    g = g.withColumn("runs", rg.merged(F.transform("xs", lambda x: rg.run(x * F.col("k"), (x + 1) * F.col("k")))))
    side = (8 * F.col("k")).cast("int")
    return g.select(*ITEM, F.explode(_rows()).alias("y"), "runs", side.alias("height"), side.alias("width"))


def above(t, cut):
    return block_rows(blocks(t).where(F.col("v") >= cut).withColumn("item", F.lit(0)))


def described(rows, *ids):
    return rg.measures(rows, ids).select(*ids, "area", *[F.col(c).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])


_FAR = "greatest({b}*p.k-p.{p}, p.{p}-({b}*p.k+p.k-1), 0)"
_REACH = ",".join(f"({d},{r})" for d, r in REACH.items())
_PX = "(SELECT image_id, k, y*k+i//k AS py, x*k+i%k AS px FROM {t}, range(36) r(i) WHERE i<k*k)"


@query("r19_split_region", "raster", BLOCKS + f""", m AS (SELECT * FROM bl WHERE v>=-0.06), pb AS (SELECT image_id, k, b FROM m, range(36) r(i) WHERE i<k*k),
 lv AS (SELECT image_id, k, count(*) AS area, greatest(quantile_cont(CAST(b AS DOUBLE),0.78), avg(b)+0.8*stddev_pop(b), max(b)*0.45) AS lev FROM pb GROUP BY 1,2 HAVING count(*)>=0.035*64*k*k),
 mk AS (SELECT m.image_id, y, x FROM m JOIN lv USING (image_id) WHERE b>=lev)""" + comp("mk", "c8") + f""",
 sd AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id ORDER BY label) AS part FROM (SELECT image_id, label, k, area, count(*)*k*k AS own FROM c8 JOIN lv USING (image_id) GROUP BY 1,2,3,4 HAVING count(*)*k*k > greatest(12, area*0.025))),
 sb AS (SELECT c8.image_id, c8.y, c8.x, sd.part FROM c8 JOIN sd USING (image_id, label) WHERE n>=2 AND part<=8),
 cl AS (SELECT p.image_id, p.k, py, px, min(part) AS part FROM {_PX.format(t='m')} p JOIN sb USING (image_id) JOIN (VALUES {_REACH}) r(d, reach) ON r.d={_FAR.format(b='sb.y', p='py')} WHERE {_FAR.format(b='sb.x', p='px')}<=r.reach GROUP BY 1,2,3,4),
 ar AS (SELECT image_id, part, count(*) AS own FROM cl GROUP BY 1,2),
 sp AS (SELECT image_id FROM ar JOIN lv USING (image_id) GROUP BY image_id, area HAVING count(*) FILTER (own>20)>1 AND sum(own)/area>0.35)
 SELECT image_id, CAST(part AS BIGINT) AS part, count(*) AS area, min(px) AS x1, min(py) AS y1, max(px)+1 AS x2, max(py)+1 AS y2 FROM cl JOIN ar USING (image_id, part) WHERE own>20 AND image_id IN (FROM sp) GROUP BY 1,2
 UNION ALL SELECT image_id, 0, count(*), min(px), min(py), max(px)+1, max(py)+1 FROM {_PX.format(t='m')} p WHERE image_id NOT IN (FROM sp) GROUP BY 1""")
def _(t):
    rows = rg.split_at_peaks(above(t, -0.06), heat(t), ITEM)
    return described(rows, "image_id", "part").withColumn("part", F.col("part").cast("bigint"))


@query("r19_split_fragments", "raster", BLOCKS + ", mk AS (SELECT image_id, y, x FROM bl WHERE v>=0.07)" + comp("mk", "c8") + f""",
 pt AS (SELECT image_id, label, count(*) AS cells, 4+image_id%3 AS k FROM c8 GROUP BY 1,2),
 bx AS (SELECT image_id, count(*) AS cells, (max(x)-min(x)+1)*(max(y)-min(y)+1) AS box FROM mk GROUP BY 1),
 lg AS (SELECT pt.*, count(*) OVER (PARTITION BY image_id) AS n, max(pt.cells) OVER (PARTITION BY image_id) AS largest, row_number() OVER (PARTITION BY image_id ORDER BY label) AS part, bx.cells AS whole, bx.box FROM pt JOIN bx USING (image_id) WHERE pt.cells*k*k>=24),
 ap AS (SELECT * FROM lg WHERE n>=2 AND box>=64*0.05 AND largest/whole<=0.82 AND part<=40),
 rw AS (SELECT * FROM bl WHERE v>=0.02), px AS (SELECT * FROM {_PX.format(t='rw')}),
 ra AS (SELECT image_id, part, count(*) AS raw_area FROM (SELECT DISTINCT p.image_id, part, py, px FROM px p JOIN c8 USING (image_id) JOIN ap USING (image_id, label) WHERE {_FAR.format(b='c8.y', p='py')}<=3 AND {_FAR.format(b='c8.x', p='px')}<=3) GROUP BY 1,2)
 SELECT image_id, CAST(part AS BIGINT) AS part, ap.cells*k*k AS area, raw_area FROM ap JOIN ra USING (image_id, part)
 UNION ALL SELECT image_id, 0, cells*(4+image_id%3)*(4+image_id%3), (SELECT count(*) FROM px WHERE px.image_id=bx.image_id) FROM bx WHERE image_id NOT IN (SELECT image_id FROM ap)""")
def _(t):
    rows, raw = rg.split_fragments(above(t, 0.07), above(t, 0.02), 48, ITEM)
    ids = ["image_id", "part"]
    r = rg.measures(raw, ids).select(*ids, F.col("area").alias("raw_area"))
    return rg.measures(rows, ids).join(r, ids).select("image_id", F.col("part").cast("bigint").alias("part"), "area", "raw_area")


def windows(t):
    """Items of an image: what is warm in three overlapping windows of columns, and in two of rows."""
    cells = blocks(t).where(F.col("v") >= 0.0)
    parts = [cells.where(F.col(c).between(lo, lo + 3)).withColumn("item", F.lit(i)) for i, (c, lo) in enumerate((("x", 0), ("x", 2), ("x", 4), ("y", 1), ("y", 4)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return block_rows(out)


def merged_items(rows, members):
    n = members.groupBy("image_id", F.col("into").alias("item")).agg(F.count("*").alias("members"))
    return described(rows, *ITEM).join(n, ITEM)


@query("g12_merge_overlaps")
def _(t):
    return merged_items(*rg.merge_overlaps(windows(t), heat(t)))


@query("g13_merge_similar")
def _(t):
    """Items are single warm cells of every image's frame, whose texture and colour differ."""
    cells = blocks(t).where(F.col("v") >= 0.22)
    items = block_rows(cells.withColumn("item", (F.col("y") * 8 + F.col("x")).cast("int")))
    colour = heat(t, "b", "colour")
    texture = heat(t, "v", "v").select("image_id", "y", F.transform("v", lambda v: F.abs(v) * 500).alias("texture"))
    return merged_items(*rg.merge_similar(items, texture.join(colour, ["image_id", "y"])))
