"""Raster, component, proposal-extraction and suppression queries on 8 x 8 rasters."""

from pyspark.sql import functions as F

from ..core import checkpointed, r6

from ..operators import component_tree as ct
from ..operators import fusion as fu
from ..operators import raster as ra
from ..operators import tiles as tl
from .registry import query

H = W = 8
G = """, g AS (SELECT image_id, y, x, label, v, CAST(least(255,greatest(0,floor((v+0.5)*255))) AS BIGINT) AS b, (CAST(least(255,greatest(0,floor((v+0.5)*255))) AS BIGINT)*7+y*13)%256 AS gg, (CAST(least(255,greatest(0,floor((v+0.5)*255))) AS BIGINT)*3+x*29)%256 AS r FROM raster),
 gy AS (SELECT *, CAST(round(0.114*b+0.587*gg+0.299*r) AS BIGINT) AS gray FROM g) """
SQR = "sqrt({0}*{0}+{1}*{1})"


def bgr(t):
    b = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v") + 0.5) * 255))).cast("bigint")
    d = t.raster.withColumn("b", b)
    d = d.withColumn("gg", (F.col("b") * 7 + F.col("y") * 13) % 256).withColumn("r", (F.col("b") * 3 + F.col("x") * 29) % 256)
    return d.withColumn("gray", ra.gray(F.col("b"), F.col("gg"), F.col("r")))


def frames(t):
    return t.vectors.select(F.col("vec_id").alias("image_id"), F.lit(H).alias("height"), F.lit(W).alias("width"))


def px(df, **cols):
    return df.select("image_id", "y", "x", *[c.alias(n) for n, c in cols.items()])


@query("r01_colour_spaces", "raster", G + """, q AS (SELECT *, greatest(b,gg,r) AS mx, CAST(greatest(b,gg,r)-least(b,gg,r) AS DOUBLE) AS d, CASE WHEN r/255.0>0.04045 THEN pow((r/255.0+0.055)/1.055,2.4) ELSE r/255.0/12.92 END AS lr,
   CASE WHEN gg/255.0>0.04045 THEN pow((gg/255.0+0.055)/1.055,2.4) ELSE gg/255.0/12.92 END AS lg, CASE WHEN b/255.0>0.04045 THEN pow((b/255.0+0.055)/1.055,2.4) ELSE b/255.0/12.92 END AS lb FROM gy),
 z AS (SELECT *, 0.212671*lr+0.715160*lg+0.072169*lb AS yy, CASE WHEN d=0 THEN 0 WHEN mx=r THEN 60*(gg-b)/d WHEN mx=gg THEN 120+60*(b-r)/d ELSE 240+60*(r-gg)/d END AS hh FROM q)
 SELECT image_id, y, x, gray, round((CASE WHEN hh<0 THEN hh+360 ELSE hh END)/2,4) AS h, round(CASE WHEN mx=0 THEN 0 ELSE 255*d/mx END,4) AS s, mx AS val, round((CASE WHEN yy>0.008856 THEN 116*pow(yy,1.0/3)-16 ELSE 903.3*yy END)*255/100,4) AS l FROM z""")
def _(t):
    d = bgr(t)
    c = [F.col("b"), F.col("gg"), F.col("r")]
    hs, la = ra.hsv(*c), ra.lab(*c)
    return px(d, gray=F.col("gray"), h=F.round(hs["h"], 4), s=F.round(hs["s"], 4), val=hs["v"], l=F.round(la["l"], 4))


@query("r02_brightness_contrast", "raster", G + "SELECT image_id, y, x, CAST(least(255, round_even(abs(1.3*gray-12),0)) AS BIGINT) AS v FROM gy")
def _(t):
    return px(bgr(t), v=ra.brightness_contrast(F.col("gray"), -12, 30))


@query("r03_resize_area", "raster", """, w AS (SELECT image_id, ty, tx, v, greatest(0, least((y+1)*0.375,ty+1)-greatest(y*0.375,ty))*greatest(0, least((x+1)*0.375,tx+1)-greatest(x*0.375,tx)) AS wt FROM raster, range(3) a(ty), range(3) b(tx))
 SELECT image_id, CAST(ty AS BIGINT) AS y, CAST(tx AS BIGINT) AS x, round(sum(v*wt)/sum(wt),6) AS v FROM w WHERE wt>0 GROUP BY 1,2,3""")
def _(t):
    return px(ra.resize_area(t.raster, ["v"], (H, W), (3, 3)), v=r6("v"))


@query("r03_letterbox_restore", "raster", """SELECT image_id, y, x, round(avg(v) OVER (PARTITION BY image_id, y//2, x//2),6) AS v FROM raster""")
def _(t):
    small = ra.letterbox(ra.resize_area(t.raster, ["v"], (H, W), (4, 4)), (4, 4), 6)
    return px(ra.restore_map(small, (4, 4), (H, W), (1, 1)), v=r6("v"))


_MIR = "CASE WHEN {c}+{d}<0 THEN -({c}+{d}) WHEN {c}+{d}>7 THEN 14-({c}+{d}) ELSE {c}+{d} END"


def _conv(kern, v="gray"):
    w = [(dy, dx, k) for dy, row in zip((-1, 0, 1), kern) for dx, k in zip((-1, 0, 1), row)]
    return f"""(SELECT a.image_id, a.y, a.x, sum(k*b.{v}) AS c FROM gy a, (VALUES {",".join(f"({dy},{dx},CAST({k} AS DOUBLE))" for dy, dx, k in w)}) k(dy,dx,k), gy b
      WHERE b.image_id=a.image_id AND b.y={_MIR.format(c='a.y', d='dy')} AND b.x={_MIR.format(c='a.x', d='dx')} GROUP BY 1,2,3)"""


@query("r04_convolve", "raster", G + f"""SELECT image_id, y, x, round(s.c,6) AS sharpen, round(l.c,6) AS laplacian, round({SQR.format('gx.c', 'gv.c')},6) AS magnitude FROM {_conv(ra.SHARPEN)} s JOIN {_conv(ra.LAPLACE)} l USING (image_id,y,x)
  JOIN {_conv(ra.SOBEL_X)} gx USING (image_id,y,x) JOIN {_conv(ra.SOBEL_Y)} gv USING (image_id,y,x)""")
def _(t):
    n = ra.neighbours(bgr(t), "gray")
    gx, gy = ra.kernel(ra.SOBEL_X), ra.kernel(ra.SOBEL_Y)
    return px(n, sharpen=r6(ra.kernel(ra.SHARPEN)), laplacian=r6(ra.kernel(ra.LAPLACE)), magnitude=r6(F.sqrt(gx * gx + gy * gy)))


@query("r04_gaussian", "raster", G + f"""SELECT a.image_id, a.y, a.x, round(sum(ky.w*kx.w*b.gray)/256.0,6) AS v FROM gy a, (VALUES (-2,1),(-1,4),(0,6),(1,4),(2,1)) ky(d,w), (VALUES (-2,1),(-1,4),(0,6),(1,4),(2,1)) kx(d,w), gy b
  WHERE b.image_id=a.image_id AND b.y={_MIR.format(c='a.y', d='ky.d')} AND b.x={_MIR.format(c='a.x', d='kx.d')} GROUP BY 1,2,3""")
def _(t):
    return px(ra.gaussian5(bgr(t), "gray", "s"), v=r6("s"))


@query("r05_box_stats", "raster", G + "SELECT a.image_id, a.y, a.x, round(avg(b.gray),6) AS local_mean, round(stddev_pop(b.gray),6) AS local_std FROM gy a JOIN gy b ON a.image_id=b.image_id AND abs(a.y-b.y)<=2 AND abs(a.x-b.x)<=2 GROUP BY 1,2,3")
def _(t):
    return px(ra.box_stats(bgr(t), "gray", 2), local_mean=r6("local_mean"), local_std=r6("local_std"))


@query("r06_lbp", "raster", G + """SELECT a.image_id, a.y, a.x, CAST(sum(CASE WHEN b.gray>=a.gray THEN k.w ELSE 0 END) AS BIGINT) AS lbp FROM gy a, (VALUES (-1,-1,1),(-1,0,2),(-1,1,4),(0,1,8),(1,1,16),(1,0,32),(1,-1,64),(0,-1,128)) k(dy,dx,w), gy b
  WHERE b.image_id=a.image_id AND b.y=least(7,greatest(0,a.y+dy)) AND b.x=least(7,greatest(0,a.x+dx)) GROUP BY 1,2,3""")
def _(t):
    return px(ra.lbp(bgr(t), "gray"), lbp=F.col("lbp").cast("bigint"))


@query("r07_minmax_normalise", "raster", "SELECT image_id, y, x, round((v-min(v) OVER (PARTITION BY image_id))*255/(max(v) OVER (PARTITION BY image_id)-min(v) OVER (PARTITION BY image_id)),6) AS v FROM raster")
def _(t):
    return px(ra.minmax(t.raster, ["v"]), v=r6("v"))


@query("r08_threshold", "raster", G + """SELECT a.image_id, a.y, a.x, any_value(a.gray)<=128 AS fixed_inverse, any_value(a.gray)>avg(b.gray)+2 AS adaptive FROM gy a JOIN gy b ON a.image_id=b.image_id AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY 1,2,3""")
def _(t):
    return px(ra.adaptive_threshold(bgr(t), "gray", 1), fixed_inverse=F.col("gray") <= 128, adaptive=F.col("foreground"))


@query("r10_evidence_fusion", "raster", G + """, h AS (SELECT image_id, y, x, 0.18*gray+0.12*b+0.16*r+0.20*gg+0.12*gray+0.16*b+0.06*CASE WHEN gray<=128 THEN 255 ELSE 0 END AS e FROM gy)
 SELECT image_id, y, x, round((e-min(e) OVER (PARTITION BY image_id))*255/(max(e) OVER (PARTITION BY image_id)-min(e) OVER (PARTITION BY image_id)),6) AS strength FROM h""")
def _(t):
    m = {"sobel": F.col("gray"), "laplacian": F.col("b"), "edges": F.col("r"), "texture": F.col("gg"), "lbp": F.col("gray"), "colour": F.col("b"), "threshold": F.when(F.col("gray") <= 128, 255).otherwise(0)}
    e = sum((w * m[k] for k, w in ra.EVIDENCE.items()), F.lit(0.0))
    return px(ra.minmax(bgr(t).withColumn("e", e), ["e"]), strength=r6("e"))


_VOTE = """, q AS (SELECT image_id, greatest(quantile_cont(gray,0.82),1) AS a, greatest(quantile_cont(r,0.82),1) AS c, greatest(quantile_cont(gg,0.65),1) AS d FROM gy GROUP BY 1),
 f0 AS (SELECT image_id, y, x, CASE WHEN gray>=a THEN 1 ELSE 0 END+CASE WHEN r>=c THEN 1 ELSE 0 END+CASE WHEN gg>=d THEN 1 ELSE 0 END AS votes, b FROM gy JOIN q USING (image_id)), f1 AS (SELECT *, 0.58*b+32*votes AS f FROM f0),
 f2 AS (SELECT *, round((f-min(f) OVER w)*255/(max(f) OVER w-min(f) OVER w),9) AS fused FROM f1 WINDOW w AS (PARTITION BY image_id)), f3 AS (SELECT *, quantile_cont(fused,0.82) OVER (PARTITION BY image_id) AS cut FROM f2) """


@query("r11_vote_fusion", "raster", G + _VOTE + "SELECT image_id, y, x, round(fused,6) AS fused, CAST(votes AS BIGINT) AS votes, fused>=cut AND votes>=2 AS seed FROM f3")
def _(t):
    d = ra.vote_fusion(bgr(t).select("image_id", "y", "x", "gray", "r", "gg", "b"), {"gray": 0.82, "r": 0.82, "gg": 0.65}, "b")
    return px(d, fused=r6(F.round("fused", 9)), votes=F.col("votes").cast("bigint"), seed=F.col("seed"))


_TILE_MAPS = ["sobel", "laplacian", "edges", "texture", "colour"]


@query("r12_tile_scores", "raster", G + f""", mp AS MATERIALIZED (SELECT gy.image_id, gy.y, gy.x, b, gg, r, gray, {SQR.format('gx.c', 'gv.c')} AS sobel, abs(l.c) AS laplacian, CASE WHEN {SQR.format('gx.c', 'gv.c')}>150 THEN 255.0 ELSE 0.0 END AS edges, abs(gray-128.0) AS texture, CAST(abs(b-r) AS DOUBLE) AS colour
   FROM gy JOIN {_conv(ra.LAPLACE)} l USING (image_id,y,x) JOIN {_conv(ra.SOBEL_X)} gx USING (image_id,y,x) JOIN {_conv(ra.SOBEL_Y)} gv USING (image_id,y,x)), gm AS (SELECT image_id, {', '.join(f'avg({c}) AS m_{c}' for c in _TILE_MAPS)} FROM mp GROUP BY 1),
 tl AS MATERIALIZED (SELECT mp.*, s, ty, tx, (mp.y BETWEEN ty*(s//2) AND ty*(s//2)+s-1 AND mp.x BETWEEN tx*(s//2) AND tx*(s//2)+s-1) AS ins FROM mp, (VALUES (4),(5),(7)) s(s), range(3) a(ty), range(3) b(tx)
   WHERE ty*(s//2)<=8-s AND tx*(s//2)<=8-s AND mp.y BETWEEN (ty-1)*(s//2) AND (ty+1)*(s//2)+s-1 AND mp.x BETWEEN (tx-1)*(s//2) AND (tx+1)*(s//2)+s-1),
 hb AS (SELECT image_id, s, ty, tx, gray//8 AS k, count(*) AS n FROM tl WHERE ins GROUP BY 1,2,3,4,5), en AS (SELECT image_id, s, ty, tx, sum(-n/CAST(s*s AS DOUBLE)*log2(n/CAST(s*s AS DOUBLE)))/5 AS e FROM hb GROUP BY 1,2,3,4),
 st AS (SELECT image_id, s, ty, tx, {', '.join(f'avg({c}) FILTER (ins) AS {c}' for c in _TILE_MAPS)}, sqrt({'+'.join(f'(avg({c}) FILTER (ins)-avg({c}))**2' for c in ('b', 'gg', 'r'))})/45 AS cd, abs(stddev_pop(gray) FILTER (ins)-stddev_pop(gray))/35 AS dv FROM tl GROUP BY 1,2,3,4),
 l AS (SELECT image_id, s, ty, tx, unnest(range(8)) AS nm, unnest([{', '.join(f'{c}/greatest(m_{c}*2.5,20)' for c in _TILE_MAPS)}, cd, e, dv]) AS f FROM st JOIN en USING (image_id,s,ty,tx) JOIN gm USING (image_id)),
 q AS (SELECT image_id, nm, quantile_cont(f,0.97) AS p97 FROM l GROUP BY 1,2), lc AS (SELECT l.*, least(f,p97) AS c FROM l JOIN q USING (image_id,nm)), u AS (SELECT image_id, nm, quantile_cont(c,0.9) AS p90 FROM lc GROUP BY 1,2),
 sc AS (SELECT image_id, s, ty, tx, least(1.0,greatest(0.0,avg(c/greatest(p90,1e-6)))) AS sc FROM lc JOIN u USING (image_id,nm) GROUP BY 1,2,3,4)
 SELECT image_id, y, x, round(coalesce(v,0),6) AS tile_score FROM mp LEFT JOIN (SELECT image_id, y, x, avg(sc) AS v FROM tl JOIN sc USING (image_id,s,ty,tx) WHERE ins GROUP BY 1,2,3) USING (image_id,y,x)""")
def _(t):
    n = ra.neighbours(bgr(t), "gray")
    gx, gy = ra.kernel(ra.SOBEL_X), ra.kernel(ra.SOBEL_Y)
    d = n.select("image_id", "y", "x", "b", "gg", "r", "gray", F.sqrt(gx * gx + gy * gy).alias("sobel"), F.abs(ra.kernel(ra.LAPLACE)).alias("laplacian"), F.abs(F.col("gray") - 128).alias("texture"), F.abs(F.col("b") - F.col("r")).alias("colour"))
    d = d.withColumn("edges", F.when(F.col("sobel") > 150, 255.0).otherwise(0.0))
    return px(tl.tile_scores(d, frames(t), _TILE_MAPS, ["b", "gg", "r"], ratios=(0.5, 0.65, 0.9), least=4), tile_score=r6("tile_score"))


@query("r12_detector_tile_scores")
def _(t):
    sized = bgr(t).select("image_id", "y", "x", "b", F.col("gg").alias("g"), "r", F.lit(H).alias("height"), F.lit(W).alias("width"))
    lab = ra.lab(F.col("b"), F.col("g"), F.col("r"))
    d = ra.feature_maps(sized, H, W, radius=2, maps=_TILE_MAPS).select("*", *[v.alias(f"lab_{k}") for k, v in lab.items()])
    return px(tl.tile_scores(d, None, _TILE_MAPS, [f"lab_{k}" for k in lab], ratios=(0.5, 0.65, 0.9), least=4), tile_score=r6("tile_score"))


# ---- masks --------------------------------------------------------------------------------
MASK = ", mk AS (SELECT image_id, y, x FROM raster WHERE v>=0.05) "


def mask(t):
    return t.raster.where("v >= 0.05").select("image_id", "y", "x")


def _dil(src, off):
    return f"(SELECT DISTINCT m.image_id, m.y+dy AS y, m.x+dx AS x FROM {src} m, (VALUES {','.join(f'({a},{b})' for a, b in off)}) o(dy,dx) WHERE m.y+dy BETWEEN 0 AND 7 AND m.x+dx BETWEEN 0 AND 7)"


def _ero(src, off):
    inv = f"(SELECT f.* FROM (SELECT image_id, CAST(a AS BIGINT) AS y, CAST(b AS BIGINT) AS x FROM (SELECT DISTINCT image_id FROM {src}), range(8) a(a), range(8) b(b)) f ANTI JOIN {src} s USING (image_id,y,x))"
    return f"(SELECT m.* FROM {src} m ANTI JOIN {_dil(inv, [(-a, -b) for a, b in off])} d USING (image_id,y,x))"


@query("r13_morphology", "raster", MASK + f", di AS {_dil('mk', ra.ellipse(1))}, er AS {_ero('mk', ra.square(1))}, op AS {_dil('er', ra.square(1))}, " + f"d2 AS {_dil('mk', ra.square(1))}, cl AS {_ero('d2', ra.square(1))}, gr AS (SELECT * FROM d2 ANTI JOIN er USING (image_id,y,x)) "
       + " UNION ALL ".join(f"SELECT '{n}' AS op, image_id, y, x FROM {s}" for n, s in (("dilate", "di"), ("erode", "er"), ("open", "op"), ("close", "cl"), ("gradient", "gr"))))
def _(t):
    m = mask(t)
    ops = {"dilate": ra.dilate(m, ra.ellipse(1), H, W), "erode": ra.erode(m, ra.square(1), H, W), "open": ra.opened(m, ra.square(1), H, W), "close": ra.closed(m, ra.square(1), H, W), "gradient": ra.mask_gradient(m, ra.square(1), H, W)}
    out = None
    for n, d in ops.items():
        p = d.select(F.lit(n).alias("op"), "image_id", "y", "x")
        out = p if out is None else out.unionByName(p)
    return out


@query("r14_multiscale_union", "raster", MASK + f", er AS {_ero('mk', ra.square(1))}, op AS {_dil('er', ra.square(1))}, a1 AS {_dil('op', ra.ellipse(1))}, c1 AS {_ero('a1', ra.ellipse(1))}, a2 AS {_dil('op', ra.ellipse(2))}, c2 AS {_ero('a2', ra.ellipse(2))} SELECT * FROM c1 UNION SELECT * FROM c2")
def _(t):
    return ra.multiscale_union(mask(t), [1, 2], H, W)


def comp(src, name, diag=True, key="image_id"):
    adj = "abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1" if diag else "abs(a.y-b.y)+abs(a.x-b.x)=1"
    return f""", {name}_e AS (SELECT a.{key}, a.y*8+a.x AS p, b.y*8+b.x AS q FROM {src} a JOIN {src} b ON a.{key}=b.{key} AND {adj} AND (a.y<>b.y OR a.x<>b.x)),
 {name}_r({key}, p, l) AS (SELECT {key}, y*8+x, y*8+x FROM {src} UNION SELECT e.{key}, e.q, r.l FROM {name}_r r JOIN {name}_e e ON e.{key}=r.{key} AND e.p=r.p WHERE r.l<e.q),
 {name} AS (SELECT {key}, p//8 AS y, p%8 AS x, min(l) AS label FROM {name}_r GROUP BY 1,2,3) """


def labels(t):
    return checkpointed(ra.label_components(mask(t), H, W))


@query("r15_label_components", "raster", MASK + comp("mk", "c8") + "SELECT image_id, y, x, label FROM c8")
def _(t):
    return ra.label_components(mask(t), H, W).select("image_id", "y", "x", "label")


_ST = """SELECT image_id, label, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2, round(avg(x),6) AS cx, round(avg(y),6) AS cy, count(*) FILTER ((SELECT count(*) FROM c8 d WHERE d.image_id=c8.image_id AND d.label=c8.label AND abs(d.y-c8.y)+abs(d.x-c8.x)=1)<4) AS perimeter FROM c8 GROUP BY 1,2"""


@query("r16_region_stats", "raster", MASK + comp("mk", "c8") + _ST)
def _(t):
    s = ra.region_stats(labels(t), H, W)
    return s.select("image_id", "label", "area", "x1", "y1", "x2", "y2", r6("cx").alias("cx"), r6("cy").alias("cy"), "perimeter")


@query("r17_fill_holes", "raster", MASK + ", bk AS (SELECT image_id, y, x FROM raster WHERE v<0.05 AND image_id IN (SELECT image_id FROM mk))" + comp("bk", "cb", False) + """SELECT image_id, y, x FROM mk UNION ALL
  SELECT image_id, y, x FROM cb WHERE (image_id, label) NOT IN (SELECT (image_id, label) FROM cb WHERE y IN (0,7) OR x IN (0,7))""")
def _(t):
    return ra.fill_holes(mask(t), H, W)


@query("r18_keep_dominant", "raster", MASK + comp("mk", "c8") + """, s AS (SELECT image_id, label, count(*) AS a FROM c8 GROUP BY 1,2), b AS (SELECT image_id, arg_max(label, (a,-label)) AS label FROM s GROUP BY 1 HAVING max(a)>=6) SELECT c8.image_id, y, x FROM c8 JOIN b USING (image_id, label)""")
def _(t):
    return ra.keep_dominant(labels(t), 6).select("image_id", "y", "x")


@query("r20_context_ring", "raster_truth", f", o AS {_dil('raster_truth', ra.ellipse(3))}, i AS {_dil('raster_truth', ra.square(1))} SELECT o.* FROM o ANTI JOIN i USING (image_id,y,x)")
def _(t):
    return ra.context_ring(t.raster_truth, 3, H, W)


@query("r23_valid_area", "raster", G + """, d AS (SELECT image_id, y, x, CASE WHEN y=(image_id%8) THEN 5+x%2 ELSE gray END AS v FROM gy), r AS (SELECT image_id, y FROM d GROUP BY 1,2 HAVING avg(v)<18 AND stddev_pop(v)<8 AND (y<3 OR y>=5)), c AS (SELECT image_id, x FROM d GROUP BY 1,2 HAVING avg(v)<18 AND stddev_pop(v)<8 AND (x<3 OR x>=5))
 SELECT image_id, y, x FROM d WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND (image_id,y) NOT IN (SELECT (image_id,y) FROM r) AND (image_id,x) NOT IN (SELECT (image_id,x) FROM c)""")
def _(t):
    d = bgr(t).withColumn("g", F.when(F.col("y") == F.col("image_id") % 8, 5 + F.col("x") % 2).otherwise(F.col("gray")))
    return ra.valid_area(d, "g", H, W, 1, 3)


_BOX = "SELECT DISTINCT image_id, image_id%3 AS x1, image_id%2 AS y1, image_id%3+5 AS x2, image_id%2+5 AS y2 FROM raster"


def img_boxes(t):
    k = F.col("image_id")
    return t.raster.select("image_id").distinct().select("image_id", F.lit(0).alias("box_id"), (k % 3).alias("x1"), (k % 2).alias("y1"), (k % 3 + 5).alias("x2"), (k % 2 + 5).alias("y2"))


@query("r26_correct_mask", "raster", MASK + f", bx AS ({_BOX}), iv AS (SELECT r.image_id, y, x FROM raster r JOIN bx USING (image_id) WHERE x>=x1 AND x<x2 AND y>=y1 AND y<y2 AND v<0.05), e1 AS {_ero('iv', ra.ellipse(1))}" + comp("e1", "ce") + "SELECT image_id, y, x FROM ce WHERE (image_id,label) IN (SELECT (image_id,label) FROM ce GROUP BY image_id, label HAVING count(*)>=2)")
def _(t):
    return ra.correct_mask(mask(t), img_boxes(t), H, W, invert=True, steps=-1, remove_small=2)


@query("r27_crop", "raster", f", bx AS ({_BOX}) SELECT r.image_id, y-greatest(y1-1,0) AS crop_y, x-greatest(x1-1,0) AS crop_x, round(v,6) AS v FROM raster r JOIN bx USING (image_id) WHERE x>=greatest(x1-1,0) AND x<x2+1 AND y>=greatest(y1-1,0) AND y<y2+1")
def _(t):
    return ra.crop(t.raster, img_boxes(t), least=1).select("image_id", "crop_y", "crop_x", r6("v").alias("v"))


@query("r28_baseline_masks", "raster", G + ", fm AS (SELECT image_id, y, x FROM gy WHERE gray>128)" + comp("fm", "cf") + "SELECT image_id, label, count(*) AS area, rank FROM (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS rank FROM cf) WHERE rank<=8 GROUP BY 1,2,4")
def _(t):
    from pyspark.sql import Window
    lab = ra.label_components(bgr(t).where("gray > 128").select("image_id", "y", "x"), H, W)
    s = lab.groupBy("image_id", "label").agg(F.count("*").alias("area"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy("label")).cast("bigint")).where("rank <= 8")


@query("w04_rank_components", "raster", MASK + comp("mk", "c8") + """, s AS (SELECT image_id, c8.label, count(*) AS area, avg(v) AS m, min(x) AS x1, min(y) AS y1 FROM c8 JOIN raster USING (image_id,y,x) GROUP BY 1,2 HAVING count(*)>=2)
 SELECT image_id, label, area, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m DESC, area DESC, x1 DESC, y1 DESC) AS rank FROM s) WHERE rank<=8""")
def _(t):
    lab = labels(t).join(t.raster.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
    return ra.rank_components(ra.region_stats(lab, H, W, "v"), 2).select("image_id", "label", "area", "rank")


@query("f22_entropy", "raster", G + ", h AS (SELECT image_id, gray*32//256 AS b, count(*) AS n FROM gy GROUP BY 1,2) SELECT image_id, round(sum(-n/64.0*log2(n/64.0))/5,6) AS entropy FROM h GROUP BY 1")
def _(t):
    return ra.entropy(bgr(t), ["image_id"], "gray").withColumn("entropy", r6("entropy"))


@query("f23_alpha_composite", "raster", G + "SELECT image_id, y, x, gray AS dropped, (gray*r+127)//255 AS black, (gray*r+255*(255-r)+127)//255 AS white FROM gy")
def _(t):
    g, a = F.col("gray"), F.col("r")
    return px(bgr(t), dropped=ra.alpha_blend(g, a, "drop"), black=ra.alpha_blend(g, a, "black"), white=ra.alpha_blend(g, a, "white"))


# ---- candidates ---------------------------------------------------------------------------
_CND = """, cnd AS (SELECT image_id, box_id, score/1000.0 AS score, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area, l_discount*5 AS invalid_fraction, l_tax*10 AS near_fraction, (l_quantity%10)/10.0 AS context_strength, (x2-x1)*(y2-y1)/2304.0*3 AS box_share, (l_partkey%10)/10.0 AS coherence, l_discount*8 AS border_penalty, (l_suppkey%10)/10.0 AS contextual_peak FROM boxes),
 rj AS (SELECT *, CASE WHEN area<70 OR area/2304.0>0.85 THEN 'area' WHEN least(w,h)<3 THEN 'invalid_geometry' WHEN invalid_fraction>0.25 OR (near_fraction>0.72 AND context_strength<0.58) THEN 'border_band' WHEN box_share>0.22 AND coherence<0.52 THEN 'broad_low_coherence'
   WHEN border_penalty>0.55 THEN 'border_evidence' WHEN area<105 AND contextual_peak<0.45 THEN 'tiny_low_evidence' END AS reason FROM cnd) """


def cands(t):
    c = F.col
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    d = t.boxes.select("image_id", "box_id", (c("score") / 1000.0).alias("score"), w.alias("w"), h.alias("h"), (w * h).alias("area"), (c("l_discount") * 5).alias("invalid_fraction"), (c("l_tax") * 10).alias("near_fraction"),
                       ((c("l_quantity") % 10) / 10.0).alias("context_strength"), (w * h / 2304.0 * 3).alias("box_share"), ((c("l_partkey") % 10) / 10.0).alias("coherence"), (c("l_discount") * 8).alias("border_penalty"), ((c("l_suppkey") % 10) / 10.0).alias("contextual_peak"))
    return d.withColumn("reason", ra.reject_reason(70, 48 * 48))


@query("p12_candidate_reject_reason", "boxes", _CND + "SELECT coalesce(reason,'kept') AS reason, count(*) AS n FROM rj GROUP BY 1")
def _(t):
    return cands(t).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("a38_funnel_diagnostics", "boxes", _CND + """SELECT image_id, count(*) AS raw, count(*) FILTER (area>=70) AS after_area, count(*) FILTER (reason IS NULL) AS after_rules, round(min(score),1) AS minimum_score, round(median(score),1) AS median_score, round(max(score),1) AS maximum_score FROM rj GROUP BY 1""")
def _(t):
    c = cands(t).withColumn("after_area", F.col("area") >= 70).withColumn("after_rules", F.col("reason").isNull())
    return ra.funnel(c, ["after_area", "after_rules"])


@query("g11_nms", "boxes", """, n(image_id, k, kept) AS (SELECT image_id, 0, [] FROM boxes GROUP BY 1 UNION ALL
   SELECT n.image_id, n.k+1, CASE WHEN len(list_filter(n.kept, lambda c: greatest(0,least(b.x2,c.x2)-greatest(b.x1,c.x1))*greatest(0,least(b.y2,c.y2)-greatest(b.y1,c.y1))/CAST((b.x2-b.x1)*(b.y2-b.y1)+(c.x2-c.x1)*(c.y2-c.y1)-greatest(0,least(b.x2,c.x2)-greatest(b.x1,c.x1))*greatest(0,least(b.y2,c.y2)-greatest(b.y1,c.y1)) AS DOUBLE)>0.28
      OR greatest(0,least(b.x2,c.x2)-greatest(b.x1,c.x1))*greatest(0,least(b.y2,c.y2)-greatest(b.y1,c.y1))/CAST(least((b.x2-b.x1)*(b.y2-b.y1),(c.x2-c.x1)*(c.y2-c.y1)) AS DOUBLE)>0.18))=0 THEN list_append(n.kept, {'id':b.box_id,'x1':b.x1,'y1':b.y1,'x2':b.x2,'y2':b.y2}) ELSE n.kept END
   FROM n JOIN boxes b ON b.image_id=n.image_id AND b.box_id=n.k+1) SELECT image_id, unnest(kept).id AS box_id FROM n QUALIFY k=max(k) OVER (PARTITION BY image_id)""".replace("SELECT image_id, 0, [] FROM", "SELECT image_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[]) FROM"))
def _(t):
    return ra.suppress_overlaps(t.boxes).where("kept").select("image_id", "box_id")


# ---- map proposals and calibration ------------------------------------------------------------
_THR = 0.12


@query("v04_map_to_proposals", "raster", f", mk AS (SELECT image_id, y, x FROM raster WHERE v>={_THR})" + comp("mk", "c8") + """, s AS (SELECT image_id, c8.label, count(*) AS area, max(v) AS sc, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2 FROM c8 JOIN raster USING (image_id,y,x) GROUP BY 1,2 HAVING count(*)>=2)
 SELECT image_id, label, area, round(sc,6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sc DESC, area DESC, x1, y1, x2, y2) AS rank FROM s) WHERE rank<=8""")
def _(t):
    top, _p = ra.extract_proposals(t.raster.select("image_id", "y", "x", "v"), F.lit(_THR), H, W, minimum=2)
    return top.select("image_id", "label", "area", r6("score").alias("score"), "rank")


# The SQL keeps an 8 x 8 mask as one number, bit y * 8 + x, and floods one component after the other.
_LEFT, _RIGHT = (f"CAST({sum(m << 8 * y for y in range(8))} AS HUGEINT)" for m in (0b01111111, 0b11111110))  # columns that may move right, left
_WIDE = "({c} | (({c} & " + _LEFT + ") << 1) | (({c} & " + _RIGHT + ") >> 1))"
_GROWN = "(({w} | ({w} << 8) | ({w} >> 8)) & rem)".format(w=_WIDE.format(c="cur"))
_LOW = "xor({0}, {0} & ({0} - 1))"
_BIT = "(CAST(1 AS HUGEINT) << CAST(y*8+x AS INTEGER))"
CURVE = f""", tp AS (SELECT image_id, y, x FROM raster_truth UNION SELECT image_id, y, x FROM raster WHERE image_id%3=0 AND ((label IN (5,6) AND y>=6 AND x>=4) OR (label IN (8,9) AND y<=1 AND x<=3)))""" + comp("tp", "tc") + f""",
 vs AS (SELECT v, row_number() OVER (ORDER BY v)-1 AS r, count(*) OVER () AS n FROM raster), qp AS (SELECT i/100.0::DOUBLE*((SELECT count(*) FROM raster)-1) AS p FROM range(101) q(i)),
 qs AS (SELECT DISTINCT a.v+(b.v-a.v)*(p-floor(p)) AS t FROM qp JOIN vs a ON a.r=floor(p) JOIN vs b ON b.r=ceil(p)), ts AS (SELECT t FROM qs UNION ALL SELECT CAST(nextafter(CAST(max(v) AS FLOAT), CAST('inf' AS FLOAT)) AS DOUBLE) FROM raster),
 th AS (SELECT row_number() OVER (ORDER BY t DESC)-1 AS point, t FROM ts), fg AS (SELECT image_id, point, sum({_BIT}) AS m FROM raster JOIN th ON v>=t GROUP BY 1,2),
 fl(image_id, point, rem, cur, done) AS (SELECT image_id, point, CAST(m AS HUGEINT), CAST({_LOW.format('CAST(m AS HUGEINT)')} AS HUGEINT), CAST(0 AS HUGEINT) FROM fg
   UNION ALL SELECT image_id, point, CASE WHEN g=cur THEN xor(rem, cur) ELSE rem END, CASE WHEN g<>cur THEN g WHEN rem=cur THEN 0 ELSE {_LOW.format('(xor(rem, cur))')} END, CASE WHEN g=cur THEN cur ELSE 0 END FROM (SELECT *, {_GROWN} AS g FROM fl WHERE rem<>0)),
 cs AS (SELECT image_id, point, done AS mask, bit_count(done) AS area, max(v) AS sc, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM fl JOIN raster USING (image_id) WHERE done<>0 AND bit_count(done)>=2 AND (done & {_BIT})<>0 GROUP BY 1,2,3),
 ps AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY image_id, point ORDER BY sc DESC, area DESC, x1, y1, x2, y2, mask & -mask)<=8),
 tm AS (SELECT image_id, label, CAST(sum({_BIT}) AS HUGEINT) AS tmask FROM tc GROUP BY 1,2), tn AS (SELECT image_id, count(*) AS truths, min(label) AS a, max(label) AS b FROM tm GROUP BY 1),
 ok AS (SELECT image_id, point, mask, label FROM ps JOIN tm USING (image_id) WHERE bit_count(mask & tmask)/CAST(bit_count(mask | tmask) AS DOUBLE)+1e-12>=0.25),
 mt AS (SELECT image_id, point, CASE WHEN count(DISTINCT label)=2 AND count(DISTINCT mask)>=2 THEN 2 ELSE 1 END AS m FROM ok GROUP BY 1,2),
 im AS (SELECT image_id, label<5 AS clean, 'c'||(label%3) AS category, coalesce(truths,0) AS truths FROM (SELECT DISTINCT image_id, label FROM raster) LEFT JOIN tn USING (image_id)),
 pn AS (SELECT image_id, point, count(*) AS n FROM ps GROUP BY 1,2), pi AS (SELECT th.point, th.t, im.*, coalesce(n,0) AS n, coalesce(m,0) AS m FROM th CROSS JOIN im LEFT JOIN pn ON pn.point=th.point AND pn.image_id=im.image_id LEFT JOIN mt ON mt.point=th.point AND mt.image_id=im.image_id),
 cv AS (SELECT CAST(point AS INTEGER) AS point, t AS threshold, sum(n) FILTER (clean)/CAST(count(*) FILTER (clean) AS DOUBLE) AS clean_fp, count(*) FILTER (clean AND n>0)/CAST(count(*) FILTER (clean) AS DOUBLE) AS clean_any, sum(m) FILTER (NOT clean)/CAST(sum(truths) FILTER (NOT clean) AS DOUBLE) AS sensitivity,
   avg(m/CAST(truths AS DOUBLE)) FILTER (NOT clean AND truths>0) AS macro_recall, count(*) FILTER (NOT clean AND m>0)/CAST(count(*) FILTER (NOT clean) AS DOUBLE) AS image_sensitivity, sum(m) FILTER (NOT clean)/CAST(nullif(sum(n),0) AS DOUBLE) AS precision, sum(n)/CAST(count(*) AS DOUBLE) AS proposals_per_image FROM pi GROUP BY 1,2) """


def calibration(t):
    """Curve and categories at 101 pooled quantiles and one threshold above the maximum."""
    second = (F.col("label").isin(5, 6) & (F.col("y") >= 6) & (F.col("x") >= 4)) | (F.col("label").isin(8, 9) & (F.col("y") <= 1) & (F.col("x") <= 3))
    told = t.raster_truth.unionByName(t.raster.where((F.col("image_id") % 3 == 0) & second).select("image_id", "y", "x")).distinct()
    truths = checkpointed(ra.label_components(told, H, W).withColumnRenamed("label", "truth"))
    images = t.vectors.select(F.col("vec_id").alias("image_id"), (F.col("label") < 5).alias("clean"), F.concat(F.lit("c"), F.col("label") % 3).alias("category"))
    return ct.calibration_points(t.raster.select("image_id", "y", "x", "v"), truths, images, minimum=2)


_R = ["threshold", "clean_fp", "clean_any", "sensitivity", "macro_recall", "image_sensitivity", "precision", "proposals_per_image"]


@query("v05_calibration_curve", "raster_truth", CURVE + "SELECT point, " + ", ".join(f"round({c},6) AS {c}" for c in _R) + """, NOT EXISTS (SELECT 1 FROM cv o WHERE o.clean_fp<=cv.clean_fp AND o.sensitivity>=cv.sensitivity AND (o.clean_fp<cv.clean_fp OR o.sensitivity>cv.sensitivity)) AS nondominated FROM cv""")
def _(t):
    return fu.pareto(checkpointed(calibration(t)[0])).select("point", *[r6(c).alias(c) for c in _R], "nondominated")


@query("v05_category_sensitivity", "raster_truth", CURVE + "SELECT CAST(point AS INTEGER) AS point, category, round(sum(m)/CAST(sum(truths) AS DOUBLE),6) AS sensitivity FROM pi WHERE NOT clean GROUP BY 1,2")
def _(t):
    return calibration(t)[1].select("point", "category", r6("sensitivity").alias("sensitivity"))


@query("v06_calibrate", "raster_truth", CURVE + """, x AS (SELECT b, threshold AS t, max(CASE WHEN clean_fp>b THEN 1 ELSE 0 END) OVER (PARTITION BY b ORDER BY threshold DESC) AS c FROM cv, (SELECT CAST(unnest([0.25,0.5,1.0]) AS DOUBLE) AS b)),
 gx AS (SELECT b, coalesce(min(t) FILTER (c=0),(SELECT max(threshold) FROM cv)) AS t FROM x GROUP BY 1) SELECT b AS budget, round(t,6) AS threshold, round(clean_fp,6) AS clean_fp, round(clean_any,6) AS clean_any FROM (SELECT b, min(t) OVER (ORDER BY b) AS t FROM gx) JOIN cv ON cv.threshold=t""")
def _(t):
    c = checkpointed(calibration(t)[0])
    return fu.first_crossing(c).join(F.broadcast(c), "threshold").select("budget", *[r6(m).alias(m) for m in ("threshold", "clean_fp", "clean_any")])  # a row a threshold


_PM = """, pm AS (SELECT image_id, p AS proposal_id, y, x FROM raster, (VALUES (0),(1)) pp(p) WHERE y BETWEEN (label+p*2)%6 AND (label+p*2)%6+2 AND x BETWEEN (image_id+p)%6 AND (image_id+p)%6+2)"""
EVI = _PM + f""", dl AS (SELECT DISTINCT image_id, proposal_id, y+dy AS y, x+dx AS x FROM pm, (VALUES {','.join(f'({a},{b})' for a, b in ra.ellipse(2))}) o(dy,dx) WHERE y+dy BETWEEN 0 AND 7 AND x+dx BETWEEN 0 AND 7),
 al AS (SELECT image_id, proposal_id, y, x, true AS ins FROM pm UNION ALL SELECT image_id, proposal_id, y, x, false FROM dl ANTI JOIN pm USING (image_id,proposal_id,y,x)), ev AS (SELECT image_id, proposal_id, avg(v) FILTER (ins) AS inside_mean, quantile_cont(CASE WHEN ins THEN v END,0.95) AS inside_q95, count(*) FILTER (ins AND v>0.1)/CAST(count(*) FILTER (ins) AS DOUBLE) AS high_fraction,
   avg(v) FILTER (ins)-coalesce(avg(v) FILTER (NOT ins), avg(v) FILTER (ins)) AS ring_contrast, CASE WHEN count(*) FILTER (v>0.1)>0 THEN count(*) FILTER (ins AND v>0.1)/CAST(count(*) FILTER (v>0.1) AS DOUBLE) ELSE 0 END AS local_agreement FROM al JOIN raster USING (image_id,y,x) GROUP BY 1,2) """


def evidence(t):
    p = t.raster.withColumn("proposal_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    y0, x0 = (F.col("label") + F.col("proposal_id") * 2) % 6, (F.col("image_id") + F.col("proposal_id")) % 6
    m = p.where(F.col("y").between(y0, y0 + 2) & F.col("x").between(x0, x0 + 2)).select("image_id", "proposal_id", "y", "x")
    return ra.candidate_evidence(m, t.raster, 0.1, H, W)


@query("v08_candidate_evidence", "raster", EVI + "SELECT image_id, proposal_id, " + ", ".join(f"round({c},6) AS {c}" for c in fu.NORMALITY) + " FROM ev")
def _(t):
    return evidence(t).select("image_id", "proposal_id", *[r6(c).alias(c) for c in fu.NORMALITY])


@query("v13_hybrid_apply", "raster", EVI + ", bd AS (SELECT " + ", ".join(f"quantile_cont({c},0.05) AS {c}_l, quantile_cont({c},0.95) AS {c}_u" for c in fu.NORMALITY) + " FROM ev), nm AS (SELECT image_id, proposal_id, round((" + "+".join(f"greatest(0.0,least(1.0,({c}-{c}_l)/({c}_u-{c}_l)))" for c in fu.NORMALITY) + """)/5,9) AS score FROM ev, bd), sl AS (SELECT *, score>=0.5 AS selected FROM nm)
 SELECT image_id, proposal_id, round(score,6) AS score, selected, CASE WHEN selected THEN row_number() OVER (PARTITION BY image_id, selected ORDER BY score DESC, proposal_id) END AS rank, CASE WHEN selected THEN 'score_at_or_above_threshold' ELSE 'below_threshold' END AS reason FROM sl""")
def _(t):
    e = checkpointed(evidence(t))
    n = fu.normalise(e, fu.quantile_bounds(e, fu.NORMALITY), fu.NORMALITY)
    mean = sum((F.col(c) for c in fu.NORMALITY[1:]), F.col(fu.NORMALITY[0])) / 5
    s = n.withColumn("score", F.round(mean, 9)).withColumn("preserved", F.lit(False))
    return fu.apply_point(s, F.lit(0.5)).select("image_id", "proposal_id", r6("score").alias("score"), "selected", "rank", "reason")




_MAG = f"(SELECT image_id, y, x, gx.c AS gx, gv.c AS gy, sqrt(gx.c*gx.c+gv.c*gv.c) AS m FROM {_conv(ra.SOBEL_X)} gx JOIN {_conv(ra.SOBEL_Y)} gv USING (image_id,y,x))"


@query("r09_edge_hysteresis", "raster", G + f""", mg AS MATERIALIZED {_MAG}, dr AS (SELECT *, CASE WHEN abs(gy)<=0.41421356*abs(gx) THEN 0 WHEN abs(gy)>=2.41421356*abs(gx) THEN 1 WHEN gx*gy>0 THEN 2 ELSE 3 END AS d FROM mg),
 rd AS (SELECT dr.image_id, dr.y, dr.x, dr.m FROM dr JOIN mg a ON a.image_id=dr.image_id AND a.y=greatest(0,dr.y-CASE d WHEN 0 THEN 0 ELSE 1 END) AND a.x=least(7,greatest(0,dr.x+CASE d WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 1 END))
   JOIN mg b ON b.image_id=dr.image_id AND b.y=least(7,dr.y+CASE d WHEN 0 THEN 0 ELSE 1 END) AND b.x=least(7,greatest(0,dr.x+CASE d WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END)) WHERE dr.m>150 AND dr.m>=a.m AND dr.m>=b.m)""" + comp("rd", "ch") +
       "SELECT image_id, y, x FROM ch WHERE (image_id,label) IN (SELECT (image_id,label) FROM ch JOIN rd USING (image_id,y,x) WHERE m>400)")
def _(t):
    return ra.edge_hysteresis(bgr(t).select("image_id", "y", "x", "gray"), "gray", 150, 400, H, W)


@query("r21_region_contrast", "raster_truth", G + f""", o AS {_dil('raster_truth', ra.ellipse(2))}, i AS {_dil('raster_truth', ra.square(1))}, al AS (SELECT image_id, y, x, true AS ins FROM raster_truth UNION ALL SELECT image_id, y, x, false FROM o ANTI JOIN i USING (image_id,y,x)),
 p AS (SELECT al.*, b, gg, r, gray FROM al JOIN gy USING (image_id,y,x)), s AS (SELECT image_id, avg(gray) FILTER (ins)-coalesce(avg(gray) FILTER (NOT ins),avg(gray) FILTER (ins)) AS t, avg(b) FILTER (ins)-coalesce(avg(b) FILTER (NOT ins),avg(b) FILTER (ins)) AS cb, avg(gg) FILTER (ins)-coalesce(avg(gg) FILTER (NOT ins),avg(gg) FILTER (ins)) AS cg,
   avg(r) FILTER (ins)-coalesce(avg(r) FILTER (NOT ins),avg(r) FILTER (ins)) AS cr FROM p GROUP BY 1), hb AS (SELECT image_id, ins, n, sum(n) OVER (PARTITION BY image_id, ins) AS tt FROM (SELECT image_id, ins, gray*32//256 AS k, count(*) AS n FROM p GROUP BY 1,2,3)),
 en AS (SELECT image_id, ins, sum(-(n/CAST(tt AS DOUBLE))*log2(n/CAST(tt AS DOUBLE)))/5 AS e FROM hb GROUP BY 1,2), ee AS (SELECT image_id, max(e) FILTER (ins) AS ei, coalesce(max(e) FILTER (NOT ins),0) AS eo FROM en GROUP BY 1)
 SELECT image_id, round(least(abs(t)/80,1.0),6) AS local_texture_contrast, round(least(sqrt(cb*cb+cg*cg+cr*cr)/60,1.0),6) AS local_colour_contrast, round(least(abs(ei-eo),1.0),6) AS local_entropy_contrast, round(least((abs(t)+sqrt(cb*cb+cg*cg+cr*cr))/100,1.0),6) AS novelty FROM s JOIN ee USING (image_id)""")
def _(t):
    reg = t.raster_truth.withColumn("label", F.lit(0))
    c = ra.region_contrast(bgr(t).select("image_id", "y", "x", "b", "gg", "r", "gray"), reg, ["b", "gg", "r"], "gray", H, W)
    return c.select("image_id", *[r6(x).alias(x) for x in c.columns if x not in ("image_id", "label")])


@query("r30_extract_feature_maps")
def _(t):
    maps = ("sobel", "laplacian", "texture", "lbp", "colour", "edges", "strength")
    f = ra.feature_maps(bgr(t).select("image_id", "y", "x", "b", F.col("gg").alias("g"), "r"), H, W, radius=2, maps=maps)
    return f.select("image_id", "y", "x", *[r6(c).alias(c) for c in maps])


@query("r31_tile_equalise", "raster", G + """, h AS (SELECT image_id, y//4 AS ty, x//4 AS tx, gray AS lv, count(*) AS n FROM gy GROUP BY 1,2,3,4), ex AS (SELECT image_id, ty, tx, sum(greatest(n-1.0,0)) AS e FROM h GROUP BY 1,2,3),
 lv AS (SELECT ex.*, CAST(k AS BIGINT) AS lv FROM ex, range(256) r(k)), lut AS (SELECT image_id, ty, tx, lv, (sum(least(coalesce(n,0),1.0)) OVER (PARTITION BY image_id, ty, tx ORDER BY lv)+(lv+1)*e/256.0)*255.0/16 AS c FROM lv LEFT JOIN h USING (image_id,ty,tx,lv)),
 w AS (SELECT image_id, y, x, gray, CAST(greatest(0,least(1,floor((y+0.5)/4-0.5)+dy)) AS BIGINT) AS ty, CAST(greatest(0,least(1,floor((x+0.5)/4-0.5)+dx)) AS BIGINT) AS tx, CASE WHEN dy=0 THEN 1-((y+0.5)/4-0.5-floor((y+0.5)/4-0.5)) ELSE (y+0.5)/4-0.5-floor((y+0.5)/4-0.5) END*CASE WHEN dx=0 THEN 1-((x+0.5)/4-0.5-floor((x+0.5)/4-0.5)) ELSE (x+0.5)/4-0.5-floor((x+0.5)/4-0.5) END AS wt
   FROM gy, (VALUES (0),(1)) a(dy), (VALUES (0),(1)) b(dx)) SELECT w.image_id, w.y, w.x, round(sum(wt*c),4) AS v FROM w JOIN lut ON lut.image_id=w.image_id AND lut.ty=w.ty AND lut.tx=w.tx AND lut.lv=gray GROUP BY 1,2,3""")
def _(t):
    return px(ra.tile_equalise(bgr(t), "gray", H, W, (2, 2)), v=F.round("gray", 4))


@query("r24_mask_stability")
def _(t):
    return ra.mask_stability(bgr(t).select("image_id", "y", "x", "gray"), mask(t), "gray", H, W, 2).withColumn("stability", r6("stability"))


@query("r22_coherence")
def _(t):
    lab = labels(t).join(bgr(t).select("image_id", "y", "x", F.col("gray").cast("double").alias("v")), ["image_id", "y", "x"])
    c = ra.coherence(checkpointed(lab), H, W)
    return c.select("image_id", "label", "area", *[r6(x).alias(x) for x in ("connectedness", "solidity", "heat_consistency", "peak_score", "coherence")])


_SPEC_METRICS = ("entropy", "boundary_smoothness", "geometric_irregularity", "scale_agreement", "local_texture_contrast", "component_count")
_U = "greatest(0.0,least(1.0,{}))".format


def _specular_sql() -> str:
    """The same measures in SQL: pixels by region and ring, then one row a region."""
    ring = f"(SELECT * FROM {_dil('raster_truth', ra.ellipse(2))} ANTI JOIN {_dil('raster_truth', ra.square(1))} USING (image_id,y,x))"
    guard = "least(greatest(0.9*crack_safeguard,0.9*pitting_safeguard),0.95)"
    optical = " + ".join(f"{w}*{n}" for n, w in ra.OPTICAL_WEIGHTS.items())
    lin = lambda c: f"CASE WHEN {c}/255.0>0.04045 THEN pow(({c}/255.0+0.055)/1.055,2.4) ELSE {c}/255.0/12.92 END"
    root = lambda c: f"CASE WHEN {c}>0.008856 THEN pow({c},1.0/3) ELSE 7.787*{c}+16.0/116 END"
    return G + f""", core AS {_ero('raster_truth', ra.square(1))}, ring AS {ring}, mg AS MATERIALIZED {_MAG},
 ln AS (SELECT *, greatest(b,gg,r)/255.0 AS val, CASE WHEN greatest(b,gg,r)=0 THEN 0.0 ELSE (greatest(b,gg,r)-least(b,gg,r))/CAST(greatest(b,gg,r) AS DOUBLE) END AS sat, greatest(b,gg,r)-least(b,gg,r) AS rg,
   {lin('r')} AS lr, {lin('gg')} AS lg, {lin('b')} AS lb FROM gy),
 xyz AS (SELECT *, (0.412453*lr+0.357580*lg+0.180423*lb)/0.950456 AS cx, 0.212671*lr+0.715160*lg+0.072169*lb AS cy, (0.019334*lr+0.119193*lg+0.950227*lb)/1.088754 AS cz FROM ln),
 chr AS (SELECT *, sqrt(pow(500*(({root('cx')})-({root('cy')})),2)+pow(200*(({root('cy')})-({root('cz')})),2)) AS chroma FROM xyz),
 al AS (SELECT t.image_id, t.y, t.x, true AS ins, c.image_id IS NOT NULL AS cor FROM raster_truth t LEFT JOIN core c USING (image_id,y,x) UNION ALL SELECT image_id, y, x, false, false FROM ring),
 q AS (SELECT al.*, c.val, c.sat, c.rg, c.chroma, c.gray, mg.m FROM al JOIN chr c USING (image_id,y,x) JOIN mg USING (image_id,y,x)),
 a AS (SELECT image_id, avg(CAST(val>0.88 AND sat<0.22 AS INT)) FILTER (ins) AS bright_low_saturation, avg(CAST(val>0.82 AS INT)) FILTER (ins) AS high_value, 1-avg(sat) FILTER (ins) AS low_saturation, 1-avg(rg) FILTER (ins)/255 AS channel_similarity,
   1-least(avg(chroma) FILTER (ins)/75,1.0) AS low_chroma, avg(val) FILTER (ins) AS mean_value, stddev_pop(gray) FILTER (ins) AS spread, avg(gray) FILTER (NOT ins) AS around, count(*) FILTER (ins) AS area, count(*) FILTER (cor) AS ca,
   stddev_pop(gray) FILTER (cor) AS cs, avg(m) FILTER (cor) AS cm, avg(m) FILTER (ins) AS am, max(x) FILTER (ins)-min(x) FILTER (ins)+1 AS w, max(y) FILTER (ins)-min(y) FILTER (ins)+1 AS h FROM q GROUP BY 1),
 mt AS (SELECT image_id, (image_id%10)/10.0 AS entropy, (image_id%7)/7.0 AS boundary_smoothness, (image_id%5)/8.0 AS geometric_irregularity, 0.75 AS scale_agreement, (image_id%4)/5.0 AS local_texture_contrast, 1+image_id%3 AS component_count FROM a),
 f AS (SELECT *, 1-least(spread/64,1.0) AS intensity_smoothness, 1-least(entropy,1.0) AS low_entropy, {_U("mean_value-coalesce(around/255,mean_value)")} AS brightness_contrast, {_U("0.55*boundary_smoothness+0.45*(1-geometric_irregularity)")} AS compactness,
   least((CASE WHEN ca>=8 THEN cs ELSE spread END)/64,1.0) AS core_texture, least((CASE WHEN ca>=8 THEN cm ELSE am END)/128,1.0) AS core_gradient, greatest(w/CAST(h AS DOUBLE),h/CAST(w AS DOUBLE)) AS aspect, area/CAST(w*h AS DOUBLE) AS occupancy FROM a JOIN mt USING (image_id)),
 s AS (SELECT *, {_U("greatest(core_texture,core_gradient,geometric_irregularity)")} AS structural_strength, {_U("(aspect-2.5)/5")} AS el, {_U("(0.42-occupancy)/0.32")} AS th FROM f),
 k AS (SELECT image_id, {_U(_U(optical) + "*(0.30+0.70*" + _U("0.55*mean_value+0.45*high_value") + ")*(0.65+0.35*(1-structural_strength))")} AS specular_likelihood, structural_strength,
   {_U("greatest(el,0.65*el+0.35*th)*(0.65+0.35*scale_agreement)")} AS crack_safeguard, {_U("greatest(" + _U("(component_count-1)/4.0") + ",geometric_irregularity*greatest(core_texture,local_texture_contrast))")} AS pitting_safeguard FROM s),
 e AS (SELECT *, specular_likelihood*(1-{guard}) AS eff FROM k)
 SELECT image_id, round(specular_likelihood,6) AS specular_likelihood, round(structural_strength,6) AS structural_strength, round(crack_safeguard,6) AS crack_safeguard, round(pitting_safeguard,6) AS pitting_safeguard,
   round(least(eff*0.65,0.85),6) AS penalty, CASE WHEN crack_safeguard>=pitting_safeguard AND crack_safeguard>0.2 THEN 'crack' WHEN pitting_safeguard>0.2 THEN 'pitting' ELSE 'none' END AS safeguard,
   CASE WHEN eff>=0.5 AND structural_strength<0.42 THEN 'rejected' WHEN least(eff*0.65,0.85)>0.01 THEN 'penalized' ELSE 'retained' END AS decision FROM e"""


@query("r25_specular_evidence", "raster_truth", _specular_sql())
def _(t):
    k = F.col("image_id")
    metrics = t.raster_truth.select("image_id").distinct().select(
        "image_id", ((k % 10) / 10.0).alias("entropy"), ((k % 7) / 7.0).alias("boundary_smoothness"), ((k % 5) / 8.0).alias("geometric_irregularity"),
        F.lit(0.75).alias("scale_agreement"), ((k % 4) / 5.0).alias("local_texture_contrast"), (1 + k % 3).alias("component_count"))
    e = ra.specular_decision(ra.specular_evidence(bgr(t), t.raster_truth, metrics, H, W, ids=["image_id"]))
    return e.select("image_id", *[r6(c).alias(c) for c in ("specular_likelihood", "structural_strength", "crack_safeguard", "pitting_safeguard", "penalty")], "safeguard", "decision")
