"""Queries over highlights and text boxes on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxloom.operators import spatial as sp
from taxloom.plans.result_queries import rounded
from taxloom.sources.views import view, with_views


def _page(spark, d):
    return view(spark, d, "highlights"), view(spark, d, "ocr_boxes")


def scored(spark, d):
    h = sp.scored(view(spark, d, "highlights")).select("image_id", "ord", "score", sp.bonus(F.col("color"), F.col("confidence")).alias("bonus"))
    return rounded(h, "score", "bonus")


def neighbours(spark, d):
    out = sp.neighbours(*_page(spark, d)).select("image_id", "h_ord", "b_ord", "side", "alignment", "place")
    return rounded(out, "alignment")


def context(spark, d):
    return sp.one_line(sp.surroundings(*_page(spark, d)))


def correlations(spark, d):
    return rounded(sp.correlations(*_page(spark, d)), "correlation")


def report(spark, d):
    return rounded(sp.correlation_report(sp.correlations(*_page(spark, d))), "average")


def best(spark, d):
    out = sp.best_correlations(sp.correlations(*_page(spark, d)))
    return rounded(out.select("rank", "image_id", "h_ord", "text", "regions", "correlation"), "correlation")


_AREA = "CAST(width * height AS DOUBLE)"
_SCORE = f"(CASE WHEN width * height < 1000 THEN {_AREA} / 1000 ELSE GREATEST(0.0E0, 1.0E0 - ({_AREA} - 1000) / 49000) END) * 0.3E0 + (CASE WHEN CAST(width AS DOUBLE) / height BETWEEN 0.2 AND 5.0 THEN 1.0E0 WHEN CAST(width AS DOUBLE) / height BETWEEN 0.1 AND 10.0 THEN 0.5E0 ELSE 0.1E0 END) * 0.2E0 + confidence * 0.3E0 + (CASE WHEN CAST(x AS DOUBLE) / 1000 BETWEEN 0.1 AND 0.8 AND CAST(y AS DOUBLE) / 1000 BETWEEN 0.2 AND 0.8 THEN 1.0E0 ELSE 0.5E0 END) * 0.2E0"
_PAIRS = with_views("", "highlights", "ocr_boxes").rstrip() + """, pairs AS (SELECT h.image_id, h.ord AS h_ord, b.ord AS b_ord, x, y, width, height, x + width AS hx2, y + height AS hy2, x1, y1, x2, y2, b.text, b.confidence AS bc,
 NOT (x + width < x1 OR x2 < x OR y + height < y1 OR y2 < y) AS touch,
 GREATEST(LEAST(x + width, x2) - GREATEST(x, x1), 0) AS ow, GREATEST(LEAST(y + height, y2) - GREATEST(y, y1), 0) AS oh,
 CAST(FLOOR((x1 + x2) / 2.0) AS BIGINT) AS cx, CAST(FLOOR((y1 + y2) / 2.0) AS BIGINT) AS cy, CAST(FLOOR(x + width / 2.0) AS BIGINT) AS hcx, CAST(FLOOR(y + height / 2.0) AS BIGINT) AS hcy
 FROM highlights h JOIN ocr_boxes b ON h.image_id = b.image_id),
 inside AS (SELECT image_id, h_ord, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, h_ord ORDER BY b_ord) AS k FROM pairs WHERE touch AND (x2 - x1) * (y2 - y1) > 0 AND ow * oh > 0.5 * (x2 - x1) * (y2 - y1)) t WHERE k = 1),
 near AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, h_ord ORDER BY square, b_ord) AS place FROM (SELECT *, (hcx - cx) * (hcx - cx) + (hcy - cy) * (hcy - cy) AS square,
  CASE WHEN cy < y THEN 'above' WHEN cy > hy2 THEN 'below' WHEN cx < x THEN 'left' WHEN cx > hx2 THEN 'right' ELSE 'overlapping' END AS side,
  (CAST(ow AS DOUBLE) / GREATEST(width, x2 - x1) + CAST(oh AS DOUBLE) / GREATEST(height, y2 - y1)) / 2 AS alignment
  FROM pairs WHERE NOT touch AND cx BETWEEN GREATEST(x - 100, 0) AND hx2 + 100 AND cy BETWEEN GREATEST(y - 100, 0) AND hy2 + 100) u),
 around AS (SELECT image_id, h_ord, COUNT(*) AS regions, AVG(1 / (1 + SQRT(square) / 100)) AS proximity, AVG(alignment) AS aligned, AVG(CAST(LEAST(width * height, (x2 - x1) * (y2 - y1)) AS DOUBLE) / GREATEST(width * height, (x2 - x1) * (y2 - y1))) AS size, AVG(bc) AS quality FROM near WHERE place <= 10 GROUP BY image_id, h_ord),
 scores AS (SELECT h.image_id, h.ord AS h_ord, i.text, COALESCE(a.regions, 0) AS regions, LEAST((CASE WHEN i.text IS NOT NULL THEN 0.3E0 ELSE 0 END) + COALESCE(proximity * 0.4E0, 0) + COALESCE(aligned * 0.3E0, 0) + COALESCE(size * 0.2E0, 0) + COALESCE(quality * 0.1E0, 0), 1.0E0) AS correlation
  FROM highlights h LEFT JOIN inside i ON i.image_id = h.image_id AND i.h_ord = h.ord LEFT JOIN around a ON a.image_id = h.image_id AND a.h_ord = h.ord) """

_JOINS = "((s.cx - {0}.cx) * (s.cx - {0}.cx) + (s.cy - {0}.cy) * (s.cy - {0}.cy) < 100 OR NOT (s.x2 < {0}.x OR {0}.x2 < s.x OR s.y2 < {0}.y OR {0}.y2 < s.y))"
_MERGED = with_views("", "highlights").rstrip() + f""", e AS (SELECT image_id, {{'rank': -width * height, 'ord': ord, 'x': x, 'y': y, 'x2': x + width, 'y2': y + height, 'confidence': confidence, 'color': color, 'cx': CAST(FLOOR(x + width / 2.0) AS INT), 'cy': CAST(FLOOR(y + height / 2.0) AS INT)}} AS o FROM highlights),
 img AS (SELECT image_id, LIST(o ORDER BY o) AS h FROM e GROUP BY image_id),
 seeded AS (SELECT image_id, h, LIST_REDUCE(LIST_TRANSFORM(h, lambda o: [o]), lambda acc, n: CASE WHEN LEN(LIST_FILTER(acc, lambda s: {_JOINS.format('n[1]')})) > 0 THEN acc ELSE LIST_CONCAT(acc, n) END) AS seeds FROM img),
 dealt AS (SELECT image_id, seeds, UNNEST(h) AS o FROM seeded),
 placed AS (SELECT image_id, o, CAST(LIST_POSITION(LIST_TRANSFORM(seeds, lambda s: {_JOINS.format('o')}), TRUE) - 1 AS INT) AS region FROM dealt),
 modal AS (SELECT image_id, region, color FROM (SELECT image_id, region, o.color AS color, ROW_NUMBER() OVER (PARTITION BY image_id, region ORDER BY COUNT(*) DESC, o.color) AS k FROM placed GROUP BY image_id, region, o.color) t WHERE k = 1)
 SELECT p.image_id, p.region, COUNT(*) AS members, MIN(o.x) AS x, MIN(o.y) AS y, MAX(o.x2) AS x2, MAX(o.y2) AS y2, CAST(SUM(-o.rank) AS BIGINT) AS area, ROUND(AVG(o.confidence), 6) AS confidence, MIN(m.color) AS color FROM placed p JOIN modal m ON m.image_id = p.image_id AND m.region = p.region GROUP BY p.image_id, p.region"""

QUERIES = {
    "b22_highlight_scores": scored,
    "b17_transaction_rows": lambda s, d: sp.transaction_rows(view(s, d, "highlights")).select("image_id", "ord", "x", "y", "width", "height"),
    "b18_statement_highlights": lambda s, d: sp.statement_highlights(view(s, d, "highlights")).select("image_id", "ord", "color"),
    "j9_text_inside": lambda s, d: sp.text_inside(*_page(s, d)),
    "j10_neighbours": neighbours,
    "p23_context": context,
    "b28_correlations": correlations,
    "g26_correlation_report": report,
    "g26_best_correlations": best,
    "g20_highlight_summary": lambda s, d: rounded(sp.summary(view(s, d, "highlights")), "average_confidence", places=4),
    "b19_merged_regions": lambda s, d: rounded(sp.merged(view(s, d, "highlights")), "confidence"),
}

ORACLES = {
    "g26_best_correlations": _PAIRS + "SELECT CAST(ROW_NUMBER() OVER (ORDER BY ROUND(correlation, 9) DESC, image_id, h_ord) AS INT) AS rank, image_id, h_ord, text, regions, ROUND(correlation, 6) AS correlation FROM scores ORDER BY 1 LIMIT 5",
    "b19_merged_regions": _MERGED,
    "b22_highlight_scores": with_views(f"SELECT image_id, ord, ROUND(score, 6) AS score, ROUND(bonus, 6) AS bonus FROM (SELECT image_id, ord, LEAST(GREATEST({_SCORE}, 0), 1) AS score, (CASE color WHEN 'yellow' THEN 0.2E0 WHEN 'green' THEN 0.15E0 WHEN 'pink' THEN 0.1E0 WHEN 'blue' THEN 0.05E0 ELSE 0 END) + (CASE WHEN confidence > 0.8 THEN 0.1E0 WHEN confidence > 0.6 THEN 0.05E0 ELSE 0 END) AS bonus FROM highlights) t WHERE ROUND(score, 9) >= 0.4", "highlights"),
    "b17_transaction_rows": with_views("SELECT image_id, ord, x, y, width, height FROM highlights WHERE width >= 200 AND height BETWEEN 20 AND 100 AND CAST(width AS DOUBLE) / height BETWEEN 3 AND 25 AND y >= 200 AND confidence >= 0.4", "highlights"),
    "b18_statement_highlights": with_views("SELECT image_id, ord, color FROM highlights WHERE CAST(width AS DOUBLE) / height BETWEEN 1.5 AND 20", "highlights"),
    "j9_text_inside": _PAIRS + "SELECT image_id, h_ord, text FROM inside",
    "j10_neighbours": _PAIRS + "SELECT image_id, h_ord, b_ord, side, ROUND(alignment, 6) AS alignment, place FROM near WHERE place <= 10",
    "p23_context": _PAIRS + ", n AS (SELECT image_id, h_ord, place, side, text, bc AS b_confidence, MAX(CASE WHEN bc >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, h_ord) AS any_sure FROM near WHERE place <= 10), k AS (SELECT * FROM n WHERE b_confidence >= 0.3 OR (any_sure = 0 AND place <= 3)), s AS (SELECT image_id, h_ord, side, UPPER(side) || ': ' || STRING_AGG(text, ' ' ORDER BY place) AS part FROM k GROUP BY image_id, h_ord, side), c AS (SELECT image_id, h_ord, STRING_AGG(part, ' | ' ORDER BY CASE side WHEN 'above' THEN 0 WHEN 'left' THEN 1 WHEN 'right' THEN 2 ELSE 3 END) FILTER (side <> 'overlapping') AS context FROM s GROUP BY image_id, h_ord) SELECT COALESCE(i.image_id, c.image_id) AS image_id, COALESCE(i.h_ord, c.h_ord) AS h_ord, CONCAT_WS(' | ', CASE WHEN i.text <> '' THEN 'HIGHLIGHTED: ' || i.text END, CASE WHEN c.context <> '' THEN 'CONTEXT: ' || c.context END) AS full_context FROM inside i FULL JOIN c ON c.image_id = i.image_id AND c.h_ord = i.h_ord",
    "b28_correlations": _PAIRS + "SELECT image_id, h_ord, text, regions, ROUND(correlation, 6) AS correlation FROM scores",
    "g26_correlation_report": _PAIRS + "SELECT COUNT(*) AS n, COUNT(CASE WHEN correlation > 0.7 THEN 1 END) AS high, COUNT(CASE WHEN correlation BETWEEN 0.4 AND 0.7 THEN 1 END) AS medium, COUNT(CASE WHEN correlation < 0.4 THEN 1 END) AS low, ROUND(AVG(correlation), 6) AS average, COUNT(text) AS with_text FROM scores",
    "g20_highlight_summary": with_views("SELECT NULL AS color, COUNT(*) AS n, COUNT(CASE WHEN confidence >= 0.6 THEN 1 END) AS confident, ROUND(AVG(confidence), 4) AS average_confidence FROM highlights UNION ALL SELECT color, COUNT(*), COUNT(CASE WHEN confidence >= 0.6 THEN 1 END), ROUND(AVG(confidence), 4) FROM highlights GROUP BY color", "highlights"),
}
