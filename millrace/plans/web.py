"""Web pages, splits and annotation tables."""

from pyspark.sql import functions as F

from millrace.operators import splits as P
from millrace.operators import web as W
from millrace.plans.registry import query


def features(t):
    return W.html_features(t.pages, "html", ["page_id"])


TITLE = "trim(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))"


@query(
    "html_features",
    f"""SELECT page_id, {TITLE} AS title, len(regexp_extract_all(html, '<h1[ >]'))::INT AS h1, len(regexp_extract_all(html, '</a>'))::INT AS links, len(regexp_extract_all(html, '<img'))::INT AS images,
      contains(html, 'name="viewport"') AS viewport FROM pages""",
)
def html_features(t):
    return features(t).select(
        "page_id", "title", F.size(F.filter("headings", lambda h: h["level"] == 1)).alias("h1"), F.size("links").alias("links"), F.size("images").alias("images"), "viewport"
    )


@query("seo_scores")
def seo_scores(t):
    """Word counts need the parsed body, which SQL has no reader for; the tests use small pages with known scores."""
    return W.seo_scores(features(t), ["page_id"])


@query("cro_audit")
def cro_audit(t):
    return W.cro_audit(features(t), ["page_id"])


@query(
    "url_structure",
    """
    WITH p AS (SELECT url, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages),
    i AS (SELECT 'depth' AS kind, len(s)::VARCHAR AS name FROM p UNION ALL SELECT 'pattern', '/' || array_to_string(list_transform(s, lambda x: CASE WHEN regexp_full_match(x, '[a-z][-a-z]+') AND length(x) < 30 THEN x ELSE '{slug}' END), '/') FROM p
      UNION ALL SELECT 'dynamic', 'query' FROM p WHERE regexp_extract(url, '\\?([^#]*)', 1) <> '' UNION ALL SELECT 'deep', 'deep' FROM p WHERE len(s) >= 4 UNION ALL SELECT 'directory', s[1] FROM p WHERE len(s) >= 1)
    SELECT kind, name, count(*) AS n FROM i GROUP BY 1, 2 UNION ALL SELECT 'sibling_slug', s[-1], count(*) FROM p WHERE len(s) > 0 GROUP BY 2 HAVING count(DISTINCT array_to_string(s[1:len(s) - 1], '/')) > 1
    """,
)
def url_structure(t):
    return W.url_structure(t.pages, "url")


SPOT = "('0x' || left(md5('42:' || doc_id), 13))::BIGINT"
CUT = "CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END"


@query("random_split", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {SPOT}, doc_id) AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, {CUT} AS split FROM r")
def random_split(t):
    return P.split(t.documents.select("doc_id"), "doc_id", [], (0.7, 0.2))


@query(
    "stratified_split",
    f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SPOT}, doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, {CUT} AS split FROM r",
)
def stratified_split(t):
    return P.split(t.documents.select("doc_id", "lang"), "doc_id", ["lang"], (0.7, 0.2))


@query("exact_duplicates", "WITH d AS (SELECT doc_id, md5(text) AS digest, min(doc_id) OVER (PARTITION BY md5(text)) AS kept FROM documents) SELECT doc_id, kept, digest FROM d WHERE doc_id <> kept")
def exact_duplicates(t):
    return P.exact_duplicates(t.documents, "doc_id", "text")


@query("class_balance", "SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM embeddings) AS share FROM embeddings GROUP BY 1", digits="share:6")
def class_balance(t):
    return P.class_balance(t.embeddings, "label")


def annotations(t):
    """Line items as boxes: order = image, part type number = category, quantities as sizes."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    x, y, w, h = q * 4 - 8, d * 1000, q * 2, F.col("l_tax") * 2000
    norm = [c / 200.0 for c in (x + w / 2, y + h / 2, w, h)]
    return t.lineitem.select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ann_id"), F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 30).alias("category_id"),
        F.when(F.col("l_linenumber") == 7, F.array(x, y)).otherwise(F.array(x, y, w, h)).alias("bbox"), F.array(*norm).alias("norm"),
    )


ANN = """
    a AS (SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS ann_id, l_orderkey AS image_id, l_suppkey % 30 AS category_id, l_linenumber = 7 AS short, l_quantity * 4 - 8 AS x, l_discount * 1000 AS y, l_quantity * 2 AS w, l_tax * 2000 AS h FROM lineitem)
"""


@query(
    "annotation_checks",
    f"""WITH {ANN} SELECT ann_id, 'unknown_image' AS problem, 'error' AS severity FROM a WHERE image_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT ann_id, 'unknown_category', 'warning' FROM a WHERE category_id NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT ann_id, 'bad_format', 'error' FROM a WHERE short UNION ALL SELECT ann_id, 'suspicious_box', 'warning' FROM a WHERE NOT short AND (x < 0 OR y < 0 OR w <= 0 OR h <= 0)
    UNION ALL SELECT ann_id, 'centre_outside', 'warning' FROM a WHERE NOT ((x + w / 2) / 200.0 BETWEEN 0 AND 1 AND (y + h / 2) / 200.0 BETWEEN 0 AND 1) UNION ALL SELECT ann_id, 'size_outside', 'warning' FROM a WHERE NOT (w / 200.0 > 0 AND w / 200.0 <= 1 AND h / 200.0 > 0 AND h / 200.0 <= 1)""",
)
def annotation_checks(t):
    images = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("image_id"))
    return P.annotation_checks(annotations(t), images, t.nation.select(F.col("n_nationkey").cast("long").alias("category_id")))


@query(
    "bbox_reformat",
    f"WITH {ANN} SELECT ann_id, (x + w / 2) / 640 AS cx, (y + h / 2) / 480 AS cy, w / 640 AS nw, h / 480 AS nh, x AS back_x, y AS back_y, w AS back_w, h AS back_h FROM a WHERE NOT short",
    digits="cx:6 cy:6 nw:6 nh:6 back_x back_y back_w back_h",
)
def bbox_reformat(t):
    """To the centre form and back, and corners to corner and size."""
    a = annotations(t).where(F.size("bbox") == 4)
    b = [F.get("bbox", i) for i in range(4)]
    wd, ht = F.lit(640.0), F.lit(480.0)
    c = a.select("ann_id", *[v.alias(n) for v, n in zip(P.to_centre(*b, wd, ht), ("cx", "cy", "nw", "nh"), strict=True)])
    x, y, w, h = P.from_centre(F.col("cx"), F.col("cy"), F.col("nw"), F.col("nh"), wd, ht)
    back = P.from_corners(x, y, x + w, y + h)
    return c.select("*", *[v.alias(n) for v, n in zip(back, ("back_x", "back_y", "back_w", "back_h"), strict=True)])


def enriched(t):
    """Pages with one structured-data block and one form each, made from their number."""
    k = F.col("page_id") % 5
    name = F.concat(F.lit('"Page '), F.col("page_id"), F.lit('"'))
    doc = (
        F.when(k == 0, F.concat(F.lit('{"@type": "Article", "headline": '), name, F.lit(', "image": "https://x/a.png", "author": {"name": "A"}, "url": "https://x"}')))
        .when(k == 1, F.concat(F.lit('{"@graph": [{"@type": "WebSite", "url": "https://x", "name": '), name, F.lit('}, {"@type": ["Thing", "FAQPage"], "mainEntity": []}]}')))
        .when(k == 2, F.concat(F.lit('{"@type": "Article", "headline": '), name))
        .when(k == 3, F.concat(F.lit('{"headline": '), name, F.lit("}")))
        .otherwise(F.concat(F.lit('{"@type": "Gadget", "name": '), name, F.lit("}")))
    )
    block = F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script>"))
    tel = F.when(k == 1, '<input type="tel" name="p" required>').when(k == 2, '<input name="phone2" placeholder="call">').otherwise("")
    extra = F.concat_ws("", F.transform(F.sequence(F.lit(1), k.cast("int") + 1), lambda i: F.concat(F.lit('<input name="f'), i, F.lit('">'))))
    form = F.concat(F.lit("<form>"), extra, tel, F.lit('<label for="f1">One</label>'), F.when(k == 3, "").when(k == 4, "<button>Get it</button>").otherwise('<input type="submit" value="Send">'), F.lit("</form>"))
    return W.html_features(t.pages.withColumn("html", F.concat("html", block, form)), "html", ["page_id"])


@query(
    "jsonld_validate",
    """
    WITH v(k, block, type, status, score, missing) AS (VALUES (0, 0, 'Article', 'missing_required', 58, 'datePublished'), (1, 0, 'WebSite', 'valid', 85, ''), (1, 0, 'FAQPage', 'missing_required', 30, 'mainEntity'),
      (2, 0, NULL, 'parse_error', 0, NULL), (3, 0, NULL, 'no_type', 0, NULL), (4, 0, 'Gadget', 'unknown_type', 50, NULL)) SELECT page_id, block, type, status, score, missing FROM pages JOIN v ON k = page_id % 5
    """,
)
def jsonld_validate(t):
    return W.jsonld_validate(enriched(t), ["page_id"])


@query(
    "form_fields",
    """
    WITH v(k, fields, required, phone_fields, unlabelled, weak_buttons, issues, warnings) AS (VALUES (0, 1, 0, 0, 0, 1, 0, 2), (1, 3, 1, 1, 2, 1, 2, 2), (2, 4, 0, 1, 2, 1, 1, 4), (3, 4, 0, 0, 3, 0, 2, 1), (4, 5, 0, 0, 4, 0, 1, 2))
    SELECT page_id, 0 AS form, fields, required, phone_fields, unlabelled, weak_buttons, issues, warnings, greatest(0, least(100, 100 - issues * 15 - warnings * 5 + CASE WHEN fields <= 3 THEN 5 ELSE 0 END)) AS score FROM pages JOIN v ON k = page_id % 5
    """,
)
def form_fields(t):
    return W.form_fields(enriched(t), ["page_id"])
