"""Web page tables: features from HTML, page scores, structured data, URL structure."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import text as X

# Words in a link class that make it a call to action, and words of logo images.
CTA_CLASSES = ("btn", "button", "cta", "call-to-action", "signup", "register")
LOGO_WORDS = ("logo", "partner", "client", "badge", "seal", "award", "cert")
# Weights of the page score.
SEO_WEIGHTS = {"title": 20, "description": 15, "h1": 15, "hierarchy": 10, "alt": 10, "links": 10, "words": 15, "viewport": 5}
CRO_WEIGHTS = {"cta": 0.30, "proof": 0.25, "trust": 0.20, "form": 0.15, "viewport": 0.10}
PROOF = [
    r"\b(?:testimonial|review|quote|said|says|told us|customer story)\b", r'["“”][^"“”]{20,}["“”]', r"\b\d[\d,]+ (?:reviews?|customers?|users?|clients?|companies)\b", r"\bstar[s]?\b.{0,10}\b(?:rating|review)\b",
    r"\b(?:trustpilot|g2|capterra|clutch)\b",
]
TRUST = [r"\b(?:ssl|https|secure|encrypted|tls|256.bit)\b", r"\b(?:guarantee|guaranteed|money.back|refund|risk.free|no.risk)\b", r"\b(?:privacy|gdpr|data protection|we never share|no spam|unsubscribe)\b"]
CTA_TEXT = (
    r"\b(?:get started|sign up|try free|start free|buy now|order now|get access|download|schedule|book|claim|join|subscribe|register|contact us|learn more|get quote|request demo|start trial|get demo)\b"
)
FEATURES = (
    "title string, description string, viewport boolean, headings array<struct<level:int,text:string>>, images array<struct<src:string,alt:string>>, links array<struct<href:string,text:string>>, "
    "forms int, fields int, buttons int, cta_links int, early_ctas int, logos int, jsonld array<string>, body_text string, "
    "form_rows array<struct<fields:array<struct<type:string,name:string,placeholder:string,required:boolean,autocomplete:boolean,labelled:boolean>>,buttons:array<string>>>"
)
# Button texts that say nothing.
WEAK_BUTTONS = ("submit", "send", "go", "ok")
# Required and recommended fields of structured data by type.
ARTICLE = "headline image datePublished author"
SCHEMA_FIELDS = {
    "Article": (ARTICLE, "dateModified publisher description url mainEntityOfPage"),
    "BlogPosting": (ARTICLE, "dateModified publisher description url mainEntityOfPage"),
    "NewsArticle": (ARTICLE, "dateModified publisher description url"),
    "HowTo": ("name step", "description image totalTime tool supply estimatedCost"),
    "FAQPage": ("mainEntity", ""),
    "Product": ("name offers", "description image sku brand aggregateRating"),
    "Organization": ("name url", "logo sameAs contactPoint description foundingDate"),
    "LocalBusiness": ("name address", "telephone openingHoursSpecification geo priceRange image url"),
    "BreadcrumbList": ("itemListElement", ""),
    "VideoObject": ("name description thumbnailUrl uploadDate", "duration contentUrl embedUrl interactionStatistic hasPart"),
    "WebSite": ("url", "name potentialAction"),
    "Event": ("name startDate location", "endDate description image organizer offers"),
    "Recipe": ("name image author datePublished", "description cookTime prepTime totalTime recipeYield recipeIngredient recipeInstructions aggregateRating"),
}


class _Page(HTMLParser):
    """Collects the features of one page; a small helper of ``html_features``."""

    HEADS = {f"h{i}": i for i in range(1, 7)}

    def __init__(self) -> None:
        super().__init__()
        self.open: dict[str, list[str]] = {}
        self.row: dict = {"title": "", "description": "", "viewport": False, "headings": [], "images": [], "links": [], "forms": 0, "fields": 0, "buttons": 0, "cta_links": 0, "early_ctas": 0, "logos": 0, "jsonld": [], "form_rows": []}
        self.body: list[str] = []
        self.in_body = False
        self.mute = ""
        self.place = 0
        self.href = ""
        self.level = 0
        self.ld = False
        self.cta = False
        self.form: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        r = self.row
        self._form_part(tag, a, dict(attrs))
        if self.in_body and tag not in ("script", "style", "body"):
            self.place += 1
        early = int(self.place <= 5)
        if tag == "meta":
            name = a.get("name", "").lower()
            if name == "description" or (a.get("property", "").lower() == "og:description" and not r["description"]):
                r["description"] = a.get("content", "")
            r["viewport"] = r["viewport"] or name == "viewport"
        elif tag == "body":
            self.in_body = True
        elif tag in ("script", "style"):
            self.mute = tag
            self.ld = a.get("type", "").lower() == "application/ld+json"
            if self.ld:
                self.open["ld"] = []
        elif tag == "title":
            self.open["title"] = []
        elif tag in self.HEADS:
            self.level = self.HEADS[tag]
            self.open["head"] = []
        elif tag == "img":
            r["images"].append((a.get("src", ""), dict(attrs).get("alt")))
            text = " ".join(a.get(k, "").lower() for k in ("src", "alt", "class"))
            r["logos"] += int(self.in_body and any(w in text for w in LOGO_WORDS))
        elif tag == "a":
            self.href = a.get("href", "")
            self.open["link"] = []
            self.cta = self.in_body and any(c in a.get("class", "").lower() for c in CTA_CLASSES)
        elif self.in_body and tag == "form":
            r["forms"] += 1
        elif self.in_body and tag in ("textarea", "select"):
            r["fields"] += 1
        elif self.in_body and tag == "input":
            kind = a.get("type", "text").lower()
            r["buttons"] += int(kind == "submit")
            r["early_ctas"] += early * int(kind == "submit")
            r["fields"] += int(kind not in ("hidden", "submit"))
        elif self.in_body and tag == "button":
            r["buttons"] += 1
            r["early_ctas"] += early

    def _form_part(self, tag, a, raw):
        """Fields, labels and buttons of the open form."""
        if tag == "form":
            self.form = {"fields": [], "buttons": []}
        elif self.form is None:
            return
        elif tag in ("input", "textarea", "select"):
            kind = a.get("type", "text").lower() if tag == "input" else tag
            if kind == "submit":
                self.form["buttons"].append(raw.get("value", "Submit") or "")
            elif kind != "hidden":
                hint = "" if tag == "select" else a.get("placeholder", "")
                self.form["fields"].append({"type": kind, "name": a.get("name", ""), "placeholder": hint, "required": "required" in raw, "autocomplete": tag == "input" and a.get("autocomplete", "") != "", "labelled": False})
        elif tag == "label":
            for field in self.form["fields"]:
                field["labelled"] = field["labelled"] or (a.get("for", "") != "" and field["name"] == a["for"])
        elif tag == "button":
            self.open["button"] = []

    def handle_endtag(self, tag):
        r = self.row
        if tag == "button" and "button" in self.open:
            text = "".join(x.strip() for x in self.open.pop("button"))
            if text and self.form is not None:
                self.form["buttons"].append(text)
        elif tag == "form" and self.form is not None:
            r["form_rows"].append(self.form)
            self.form = None
        if tag == self.mute:
            self.mute = ""
            if "ld" in self.open:
                r["jsonld"].append("".join(self.open.pop("ld")))
        elif tag == "title" and "title" in self.open:
            r["title"] += "".join(self.open.pop("title"))
        elif tag in self.HEADS and "head" in self.open:
            r["headings"].append((self.level, " ".join(self.open.pop("head")).strip()))
        elif tag == "a" and "link" in self.open:
            r["links"].append((self.href, " ".join(self.open.pop("link")).strip()))
            if self.cta:
                r["cta_links"] += 1
                r["early_ctas"] += int(self.place <= 5)

    def handle_data(self, data):
        for parts in self.open.values():
            parts.append(data)
        if self.in_body and not self.mute:
            self.body.append(data)


def html_features(pages: DataFrame, html: str, keys: Sequence[str]) -> DataFrame:
    """Typed features of every page, parsed in Arrow batches where the pages lie."""
    kept = pages.select(*keys, F.col(html).alias("__html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "__html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["__html"]:
                page = _Page()
                page.feed(text or "")
                page.close()
                rows.append({**page.row, "title": page.row["title"].strip(), "description": page.row["description"].strip(), "body_text": " ".join(page.body)})
            out = pd.DataFrame(rows, index=pdf.index)
            for c, names in (("headings", ("level", "text")), ("images", ("src", "alt")), ("links", ("href", "text"))):
                out[c] = [[dict(zip(names, v, strict=True)) for v in x] for x in out[c]]
            yield pd.concat([pdf.drop(columns="__html"), out], axis=1)

    return kept.mapInPandas(run, f"{fields}, {FEATURES}")


def seo_scores(features: DataFrame, keys: Sequence[str], external: Column | None = None) -> DataFrame:
    """Eight checks and their weighted total. ``external`` tells for the link column ``l`` whether it leaves the site."""
    c = F.col
    t, d = F.length("title"), F.length("description")
    h1 = F.size(F.filter("headings", lambda h: h["level"] == 1))
    skips = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("headings") - 1, F.lit(1))), lambda i: (i < F.size("headings")) & (F.get("headings", i)["level"] > F.get("headings", i - 1)["level"] + 1)))
    imgs = F.size("images")
    alt = F.when(imgs > 0, F.size(F.filter("images", lambda x: F.trim(x["alt"]) != "")) / imgs * 100).otherwise(100.0)
    links = F.size("links")
    inside = F.size(F.filter("links", lambda l: ~l["href"].rlike("^(?i)(https?:)?//")))
    ratio = F.when(links > 0, inside / links).otherwise(0.0)
    words = F.size(F.regexp_extract_all("body_text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    half = lambda x: F.bround(x, 0)
    parts = {
        "title": F.when(t.between(50, 60), 100).when(t > 0, 50).otherwise(0),
        "description": F.when(d.between(150, 160), 100).when(d.between(100, 149) | d.between(161, 200), 50).when(d > 0, 30).otherwise(0),
        "h1": F.when(h1 == 1, 100).when(h1 > 1, 50).otherwise(0),
        "hierarchy": F.greatest(F.lit(0), 100 - skips * 25),
        "alt": half(alt),
        "links": F.when((links == 0) | (ratio >= 0.5), 100.0).otherwise(half(ratio * 100)),
        "words": F.when(words >= 300, 100.0).otherwise(F.least(F.lit(100.0), half(words / 300 * 100))),
        "viewport": F.when(c("viewport"), 100).otherwise(0),
    }
    out = features.select(*keys, *[v.cast("double").alias(k) for k, v in parts.items()])
    return out.withColumn("overall", half(N.weighted_score(SEO_WEIGHTS, bound=False) / float(sum(SEO_WEIGHTS.values()))))


def cro_audit(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Call to action 30, proof 25, trust 20, form 15, viewport 10."""
    low = F.lower("body_text")
    count = lambda p: F.regexp_count(low, F.lit("(?U)" + p))
    proof = F.least(F.lit(20), sum([count(p) for p in PROOF], F.lit(0))) + F.col("logos")
    trust = sum([F.least(F.lit(1), count(p)) for p in TRUST], F.lit(0))
    ctas = F.col("buttons") + F.col("cta_links") + count(CTA_TEXT)
    cta = F.when(ctas >= 5, 100).when(ctas >= 3, 90).when(ctas >= 2, 75).when(ctas >= 1, 50).otherwise(0)
    f = F.col("fields")
    parts = {
        "cta": F.when(F.col("early_ctas") >= 1, F.least(F.lit(100), cta + 10)).otherwise(cta),
        "proof": F.when(proof >= 6, 100).when(proof >= 4, 85).when(proof >= 2, 65).when(proof >= 1, 40).otherwise(0),
        "trust": F.when(trust >= 3, 100).when(trust >= 2, 80).when(trust >= 1, 60).otherwise(20),
        "form": F.when(F.col("forms") == 0, 60).when(f <= 3, 100).when(f <= 5, 70).otherwise(F.greatest(F.lit(10), 100 - (f - 3) * 10)),
        "viewport": F.when(F.col("viewport"), 100).otherwise(0),
    }
    out = features.select(*keys, *[v.cast("double").alias(k) for k, v in parts.items()])
    return out.withColumn("overall", F.bround(N.weighted_score(CRO_WEIGHTS, bound=False), 0))


def url_structure(pages: DataFrame, url: str) -> DataFrame:
    """Depth histogram, dynamic and deep URLs, patterns and top directories, as (kind, name, count) rows of one scan."""
    path = X.url_path(url)
    parts = X.path_parts(path)
    depth = F.size(parts)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    items = F.array(
        F.struct(F.lit("depth").alias("kind"), depth.cast("string").alias("name")),
        F.struct(F.lit("pattern").alias("kind"), X.path_pattern(path).alias("name")),
        F.when(query != "", F.struct(F.lit("dynamic").alias("kind"), F.lit("query").alias("name"))),
        F.when(depth >= 4, F.struct(F.lit("deep").alias("kind"), F.lit("deep").alias("name"))),
        F.when(depth >= 1, F.struct(F.lit("directory").alias("kind"), F.get(parts, 0).alias("name"))),
    )
    rows = pages.select(F.inline(F.filter(items, lambda x: x.isNotNull())))
    counts = rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    slug = pages.select(F.element_at(F.when(depth > 0, parts), -1).alias("name"), F.array_join(F.slice(parts, 1, F.greatest(depth - 1, F.lit(0))), "/").alias("parent"))
    twins = slug.where("name IS NOT NULL").groupBy("name").agg(F.countDistinct("parent").alias("parents"), F.count(F.lit(1)).alias("n")).where("parents > 1")
    return counts.unionByName(twins.select(F.lit("sibling_slug").alias("kind"), "name", "n"))


def form_fields(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields, phone fields, missing labels, weak button text, counts of issues and warnings, and a score per form."""
    f = features.select(*keys, F.posexplode("form_rows").alias("form", "r"))
    fields, n = F.col("r.fields"), F.size("r.fields")
    count = lambda test: F.size(F.filter(fields, test))
    is_phone = lambda x: F.lower(x["name"]).contains("phone") | (x["type"] == "tel")
    phone, forced = count(is_phone), count(lambda x: is_phone(x) & x["required"])
    bare = count(lambda x: ~x["labelled"] & (x["placeholder"] == ""))
    hint = count(lambda x: ~x["labelled"] & (x["placeholder"] != ""))
    weak = F.size(F.filter("r.buttons", lambda b: F.lower(b).isin(list(WEAK_BUTTONS))))
    must = count(lambda x: x["required"])
    num = lambda test: test.cast("int")
    issues = num(n > 7) + num(forced > 0) + num(bare > 0) + num(F.size("r.buttons") == 0)
    warnings = num((n > 4) & (n <= 7)) + num((phone > 0) & (forced == 0)) + num(hint > 0) + weak + num((count(lambda x: x["autocomplete"]) == 0) & (n > 0)) + num((must == n) & (n > 2))
    out = f.select(*keys, "form", n.alias("fields"), must.alias("required"), phone.alias("phone_fields"), bare.alias("unlabelled"), weak.alias("weak_buttons"), issues.alias("issues"), warnings.alias("warnings"))
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("issues") * 15 - F.col("warnings") * 5 + F.when(F.col("fields") <= 3, 5).otherwise(0))))


def jsonld_validate(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per structured-data object: type, status, score from required (70) and recommended (30) fields, missing ones."""
    blocks = features.select(*keys, F.posexplode("jsonld").alias("block", "raw"))
    ok = F.try_parse_json("raw").isNotNull()
    members = F.from_json(F.get_json_object("raw", "$.@graph"), "array<string>")
    rows = blocks.select(*keys, "block", ok.alias("ok"), F.explode(F.coalesce(F.when(ok, members), F.array("raw"))).alias("obj"))
    named = F.get_json_object("obj", "$.@type")
    several = F.from_json(named, "array<string>")
    known = F.filter(several, lambda x: x.isin(list(SCHEMA_FIELDS)))
    kind = F.when(F.col("ok"), F.when(named.startswith("["), F.coalesce(F.get(known, 0), F.get(several, 0))).otherwise(named))
    table = lambda i: F.create_map(*[x for k, v in SCHEMA_FIELDS.items() for x in (F.lit(k), F.split(F.lit(v[i]), " ") if v[i] else F.array().cast("array<string>"))])
    rows = rows.withColumn("type", kind).withColumn("need", table(0)[F.col("type")]).withColumn("wish", table(1)[F.col("type")])

    def lacking(c: str) -> Column:
        value = lambda f: F.coalesce(F.call_function("get_json_object", F.col("obj"), F.concat(F.lit("$."), f)), F.lit(""))
        return F.filter(c, lambda f: value(f).isin("", "[]", "{}", "0", "false"))

    rows = rows.withColumn("miss", lacking("need")).withColumn("less", lacking("wish"))
    part = lambda all_, miss, points: F.when(F.size(all_) > 0, (F.size(all_) - F.size(miss)) / F.size(all_) * points).otherwise(float(points))
    listed = F.col("need").isNotNull()
    score = F.when(listed, F.floor(part("need", "miss", 70) + part("wish", "less", 30))).when(F.col("ok") & F.col("type").isNotNull(), 50).otherwise(0)
    status = F.when(~F.col("ok"), "parse_error").when(F.col("type").isNull(), "no_type").when(~listed, "unknown_type").when(F.size("miss") > 0, "missing_required").otherwise("valid")
    return rows.select(*keys, "block", "type", status.alias("status"), score.cast("int").alias("score"), F.array_join("miss", ",").alias("missing"))
