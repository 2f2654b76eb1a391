"""Reading web pages: content, links, metadata and the signs of client-side rendering."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Class or id fragments of boilerplate, and weights of tags: fixed values.
BOILERPLATE = "nav|footer|header|sidebar|ads|comment|promo|advert|social|share|cookie|popup|modal"
TAG_WEIGHTS = {
    "article": 1.8, "main": 1.6, "section": 1.4, "h1": 1.6, "h2": 1.4, "h3": 1.3, "p": 1.2, "blockquote": 1.5, "code": 1.5, "pre": 1.5,
    "li": 1.0, "td": 0.9, "div": 0.7, "span": 0.5,
}
OTHER_WEIGHT = 0.6
#: Signs of page frameworks: fixed values.
FRAMEWORKS = {
    "next.js": ("__NEXT_DATA__", "_next/static", "next/router"),
    "nuxt.js": ("__NUXT__", "_nuxt/", "nuxt-link"),
    "react": ("react-root", "data-reactroot", "data-reactid"),
    "vue.js": ("__vue__", "v-app", "data-v-"),
    "angular": ("ng-version", "_nghost", "ng-app"),
    "svelte": ("svelte-", "__svelte"),
    "remix": ("__remixContext", "remix-params-helper"),
    "gatsby": ("gatsby-focus-wrapper", "__gatsby"),
}


def visible_text(html: Column) -> Column:
    """Text outside head, script, style and comments, white space collapsed."""
    out = html
    for tag in ("head", "script", "style"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return T.strip_tags(F.regexp_replace(out, "(?s)<!--.*?-->", ""))


def links(html: Column, url: Column) -> Column:
    """href targets in order, repeated ones too: absolute ones, and root-relative ones made absolute; those
    with # or ? are left out."""
    found = F.transform(F.regexp_extract_all(html, F.lit("(?i)href=[\"']([^\"'#?]+)[\"']"), F.lit(1)), lambda x: F.trim(x))
    root = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    kept = F.filter(found, lambda x: x.startswith("http://") | x.startswith("https://") | x.startswith("/"))
    return F.transform(kept, lambda x: F.when(x.startswith("/"), F.concat(root, x)).otherwise(x))


def meta_tags(html: Column) -> Column:
    """name or property -> content of meta tags, either order of attributes; a later tag wins, and those
    of the second order win over the first."""
    named = r"""(?i)<meta\s+(?:[^>]*?\s+)?(?:property|name)=["']([^"']+)["'][^>]*content=["']([^"']*)["']"""
    turned = r"""(?i)<meta\s+(?:[^>]*?\s+)?content=["']([^"']*)["'][^>]*(?:property|name)=["']([^"']+)["']"""
    get = lambda p, g: F.regexp_extract_all(html, F.lit(p), F.lit(g))
    both = F.concat(
        F.arrays_zip(get(named, 1).alias("key"), get(named, 2).alias("value")), F.arrays_zip(get(turned, 2).alias("key"), get(turned, 1).alias("value"))
    )
    # map_from_entries refuses repeated keys: keep the last of each
    last = F.filter(both, lambda x, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def _holds(html: Column, signs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | html.contains(s)
    return out


def frameworks(html: Column) -> Column:
    """Names of the frameworks whose signs the page has, in a fixed order."""
    return F.array_compact(F.array(*[F.when(_holds(html, signs), F.lit(name)) for name, signs in FRAMEWORKS.items()]))


def client_rendered(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text_length, script_ratio, primary_framework, confidence, is_csr): 0.4 for less than 1000
    characters of text, 0.3 for more than 70 per cent of script, 0.2 for a framework, 0.1 for less
    than 200 characters; client-rendered above 0.5."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    scripts = F.aggregate(F.regexp_extract_all(html, F.lit("(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), F.lit(0), lambda a, s: a + F.length(s))
    rows = pages.select(
        id_col, F.length(visible_text(html)).alias("text_length"), F.when(F.length(html) > 0, scripts / F.length(html)).otherwise(0.0).alias("script_ratio"),
        F.get(frameworks(html), F.lit(0)).alias("primary_framework"),
    )
    points = lambda c, x: F.when(c, x).otherwise(0.0)
    score = points(F.col("text_length") < 1000, 0.4) + points(F.col("script_ratio") > 0.7, 0.3) + points(F.col("primary_framework").isNotNull(), 0.2) + points(F.col("text_length") < 200, 0.1)
    return rows.withColumn("script_ratio", F.round("script_ratio", 6)).withColumn("confidence", F.round(F.least(F.lit(1.0), score), 2)).withColumn("is_csr", F.col("confidence") > 0.5)


def content_chunks(pages: DataFrame, id_col: str, html_col: str, least: int = 50) -> DataFrame:
    """(id, chunk_index, tag, text, weight): outermost elements, left to right, whose class and id name no
    boilerplate and whose text has at least so many characters; a page without any gives its whole
    text, if it has some, with weight 1."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    for tag in ("script", "style", "noscript", "iframe"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    element = r"(?is)<(\w+)([^>]*)>(.*?)</\1>"
    cleaned = pages.select(id_col, html.alias("_h"))
    group = lambda n: F.regexp_extract_all("_h", F.lit(element), F.lit(n))
    found = cleaned.withColumn("_e", F.arrays_zip(group(1).alias("tag"), group(2).alias("attrs"), group(3).alias("inner")))
    named = lambda a: F.array_join(F.regexp_extract_all(a, F.lit("(?i)(?:class|id)=[\"']([^\"']*)[\"']"), F.lit(1)), " ")
    weight = F.create_map(*[F.lit(x) for k, v in TAG_WEIGHTS.items() for x in (k, v)])
    kept = F.filter(
        F.transform("_e", lambda x: F.struct(F.lower(x["tag"]).alias("tag"), T.strip_tags(x["inner"]).alias("text"), named(x["attrs"]).alias("named"))),
        lambda x: ~x["named"].rlike(f"(?i){BOILERPLATE}") & (F.length(x["text"]) >= least),
    )
    made = F.transform(kept, lambda x: F.struct(x["tag"].alias("tag"), x["text"].alias("text"), F.coalesce(F.try_element_at(weight, x["tag"]), F.lit(OTHER_WEIGHT)).alias("weight")))
    whole = T.strip_tags(F.col("_h"))
    spare = F.when(whole != "", F.array(F.struct(F.lit("").alias("tag"), whole.alias("text"), F.lit(1.0).alias("weight"))))
    chunks = found.withColumn("_c", made).withColumn("_c", F.when(F.size("_c") > 0, F.col("_c")).otherwise(spare))
    return chunks.select(id_col, F.posexplode("_c").alias("chunk_index", "c")).select(id_col, "chunk_index", "c.tag", "c.text", "c.weight")


def pruned_content(chunks: DataFrame, id_col: str, threshold: float = 0.48) -> DataFrame:
    """(id, n_chunks, content): chunks of at least the threshold's weight, else the first three, joined by
    blank lines."""
    per = Window.partitionBy(id_col)
    marked = chunks.withColumn("_some", F.max((F.col("weight") >= threshold).cast("int")).over(per))
    kept = marked.where((F.col("weight") >= threshold) | ((F.col("_some") == 0) & (F.col("chunk_index") < 3)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    return kept.groupBy(id_col).agg(F.count("*").alias("n_chunks"), F.array_join(listed, "\n\n").alias("content"))


_OUT = "name string, title string, description string, price double, currency string, rating double, availability string, source string"
_LD = re.compile(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.S | re.I)
_ITEM = re.compile(r"""itemprop=["']([^"']+)["'](?:[^>]*?content=["']([^"']*)["'])?[^>]*>([^<]*)""", re.I)
_META = re.compile(r"""<meta\b[^>]*>""", re.I)
_ATTR = re.compile(r"""([\w:-]+)\s*=\s*["']([^"']*)["']""")
_RDFA = re.compile(r"""\bproperty=["'](?:schema:)?(\w+)["'][^>]*>([^<]*)""", re.I)


def _number(value: object) -> float | None:
    found = re.search(r"-?\d+(?:[.,]\d+)*", str(value if value is not None else ""))
    if not found:
        return None
    raw = found[0]
    raw = raw.replace(",", "") if re.fullmatch(r"-?\d{1,3}(,\d{3})*(\.\d+)?", raw) else raw.replace(",", ".")
    try:
        return float(raw)
    except ValueError:
        return None


def _from_ld(found: object) -> dict:
    if isinstance(found, list):
        return next((x for x in map(_from_ld, found) if x), {})
    if not isinstance(found, dict):
        return {}
    if "@graph" in found:
        return _from_ld(found["@graph"])
    offers = found.get("offers") or {}
    offers = offers[0] if isinstance(offers, list) and offers else offers
    rating = found.get("aggregateRating") or {}
    offers, rating = (x if isinstance(x, dict) else {} for x in (offers, rating))
    out = {
        "name": found.get("name"), "title": found.get("headline") or found.get("name"), "description": found.get("description"), "price": _number(offers.get("price")),
        "currency": offers.get("priceCurrency"), "rating": _number(rating.get("ratingValue")), "availability": str(offers["availability"]).rsplit("/", 1)[-1] if offers.get("availability") else None,
    }
    return {k: v for k, v in out.items() if v not in (None, "")}


def structured(html: str | None) -> dict:
    """The first layer that says something: JSON-LD, microdata, embedded state, meta tags, RDFa, headings."""
    html = html or ""
    for raw in _LD.findall(html):
        try:
            if out := _from_ld(json.loads(raw)):
                return out | {"source": "json-ld"}
        except (ValueError, RecursionError):
            continue
    items = {k: (c or t).strip() for k, c, t in _ITEM.findall(html) if (c or t).strip()}
    if items:
        out = {k: items.get(k) for k in ("name", "description", "availability")}
        out |= {"title": items.get("headline") or items.get("name"), "price": _number(items.get("price")), "currency": items.get("priceCurrency"), "rating": _number(items.get("ratingValue"))}
        if any(v is not None for v in out.values()):
            return {k: v for k, v in out.items() if v is not None} | {"source": "microdata"}
    state = re.search(r"""(?:__NEXT_DATA__[^>]*>|__INITIAL_STATE__\s*=\s*)(\{.*?\})\s*(?:;|</script>)""", html, re.S)
    if state:
        try:
            if out := _from_ld(json.loads(state[1])):
                return out | {"source": "embedded"}
        except (ValueError, RecursionError):
            pass
    meta = {}
    for tag in _META.findall(html):
        attrs = {k.lower(): v for k, v in _ATTR.findall(tag)}
        if (key := attrs.get("property") or attrs.get("name")) and "content" in attrs:
            meta[key.lower()] = attrs["content"]
    out = {
        "title": meta.get("og:title") or meta.get("twitter:title"), "name": meta.get("og:site_name"), "description": meta.get("og:description") or meta.get("description"),
        "price": _number(meta.get("product:price:amount")), "currency": meta.get("product:price:currency"), "availability": meta.get("product:availability"),
    }
    if any(v is not None for v in out.values()):
        return {k: v for k, v in out.items() if v is not None} | {"source": "meta"}
    rdfa = {k.lower(): v.strip() for k, v in _RDFA.findall(html) if v.strip()}
    if rdfa:
        return {"name": rdfa.get("name"), "title": rdfa.get("headline") or rdfa.get("name"), "description": rdfa.get("description"), "price": _number(rdfa.get("price")), "source": "rdfa"}
    plain = lambda p: (m := re.search(p, html, re.S | re.I)) and re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", m[1])).strip() or None
    title = plain(r"<h1[^>]*>(.*?)</h1>") or plain(r"<title[^>]*>(.*?)</title>")
    return {"title": title, "description": plain(r"<p[^>]*>(.*?)</p>"), "source": "structural"} if title else {}


def structured_fields(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, name, title, description, price, currency, rating, availability, source) of each page."""
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [structured(x) for x in batch["h"]]
            out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)
            for n in names:
                out[n] = out[n].astype("float64") if n in ("price", "rating") else out[n].map(lambda v: None if v is None else str(v)).astype(object)
            out.insert(0, id_col, batch["i"].to_numpy())
            yield out

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).mapInPandas(run, f"{id_col} {kind}, {_OUT}")


def key_values(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, value) of lines `key: value`, the key at most 40 characters; of a repeated key the first."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    pattern = r"^\s*([A-Za-z][A-Za-z0-9 _-]{0,39}):\s+(\S.*?)\s*$"
    found = lines.where(F.col("line").rlike(pattern)).select(id_col, "pos", F.lower(F.trim(F.regexp_extract("line", pattern, 1))).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))
    return found.groupBy(id_col, "key").agg(F.min_by("value", "pos").alias("value"))


def crawl(pages: DataFrame, seeds: DataFrame, id_col: str, url_col: str, html_col: str, max_depth: int = 2, max_pages: int = 1_000_000) -> DataFrame:
    """(url, depth) of pages reached from the seeds (url) over links among the pages themselves, by level;
    once max_pages are reached no further level begins, and the last one is cut by url."""
    from quarry.session import checkpointed

    known = pages.select(F.regexp_replace(url_col, r"[?#].*$", "").alias("url"), links(F.col(html_col), F.col(url_col)).alias("to"))
    edges = checkpointed(known.select("url", F.explode("to").alias("to")).distinct())
    urls = known.select("url").distinct()
    seen = checkpointed(seeds.select("url").distinct().join(urls, "url", "left_semi").withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        reached = seen.count()
        if reached >= max_pages:
            break
        new = edges.join(front.select("url"), "url").select(F.col("to").alias("url")).distinct()
        new = new.join(urls, "url", "left_semi").join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        front = checkpointed(new.orderBy("url").limit(max_pages - reached))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen
