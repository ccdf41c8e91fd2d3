"""Page bodies as tables: triage, markers, links, JSON payloads, layout signatures, DOM extraction, reduction, discovery."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
CHALLENGE = ("captcha", "human verification", "verify that you're not a robot", "verify you are human", "cf-challenge", "just a moment", "are you a robot", "press and hold", "enable javascript and cookies")
BLOCKED = ("attention required", "incapsula", "incident id", "request unsuccessful", "access denied", "unusual traffic", "reference #", "pardon our interruption")
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
DROPPED = frozenset({"script", "style", "noscript", "iframe", "meta", "link", "picture", "source", "path", "defs", "g", "circle", "rect", "polygon", "polyline", "ellipse", "line", "mask", "clippath", "lineargradient", "stop", "filter", "pattern", "symbol", "desc"})
KEPT_ATTRIBUTES = frozenset({"class", "id", "itemprop", "itemtype", "role", "type", "name", "content", "aria-label", "aria-hidden", "aria-checked", "title", "alt", "value"})
URL_ATTRIBUTES = frozenset({"src", "srcset", "data-src", "poster", "action"})
FRAGMENT_ATTRIBUTES = frozenset(("href", "xlink:href"))
VOLATILE = re.compile(r"[mp][trblxy]?-(?:auto|\d+)|g?a?p-\d+|row-gap-\d+|column-gap-\d+|w-\d+|h-\d+|fs-[\w-]+|lh-[\w-]+|text-(?:start|end|center|nowrap|break)|d-(?:none|block|flex|inline|inline-flex|md-none|lg-none)|col(?:-\w+)*|order-\d+|z-\d+|opacity-\d+")
DOM_DEPTH, TEXT_LIMIT, PLACEHOLDER = 3, 120, "[text removed]"


def _any(c: Column, tokens: tuple[str, ...]) -> Column:
    return c.rlike("|".join(rf"\Q{t}\E" for t in tokens))


def challenged(body: Column, header: Column | None = None) -> Column:
    """Whether a response is a challenge: its mitigation header says so, or the body's beginning does."""
    said = _any(F.lower(F.substring(body, 1, 8000)), CHALLENGE)
    return said if header is None else F.coalesce(F.lower(F.trim(header)) == "challenge", F.lit(False)) | F.coalesce(said, F.lit(False))


def triage(status: Column, body: Column, markers: tuple[str, ...], least: int) -> Column:
    """One verdict a response, the first that applies."""
    head, code = F.lower(F.substring(body, 1, 8000)), status.cast("string")
    said = lambda name: F.concat(F.lit(f"{name}("), code, F.lit(")"))
    return (
        F.when(status.isNull(), "ERROR").when(_any(head, CHALLENGE), said("CHALLENGE")).when(_any(head, BLOCKED), F.concat(said("BLOCKED"), F.lit("/page")))
        .when(status == 429, said("RATE-LIMITED")).when(status.isin(403, 405, 406), said("BLOCKED")).when(status.isin(301, 302, 303, 307, 308), said("REDIRECT"))
        .when(status >= 500, said("SERVER")).when(status != 200, said("HTTP")).when(F.length(body) < least, "200/SHORT")
        .when(~_any(F.lower(body), markers), "200/NO-DATA").otherwise("200/OK")
    )


def snippet(body: Column) -> Column:
    head = F.substring(body, 1, 8000)
    for tag in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]+>"):
        head = F.regexp_replace(head, tag, " ")
    return F.substring(F.trim(F.regexp_replace(head, r"\s+", " ")), 1, 400)


def site_verdict(results: DataFrame) -> DataFrame:
    """A verdict for each site over its responses (site, verdict, ordinal): skipped, ok, challenged, blocked, untested, no
    fields, in this order; the best response is the ok one of the lowest ordinal."""
    starts = lambda s: F.max(F.col("verdict").startswith(s).cast("int"))
    seen = results.groupBy("site").agg(starts("SKIPPED").alias("s"), starts("200/OK").alias("o"), starts("CHALLENGE").alias("c"), starts("BLOCKED").alias("b"), F.min(F.when(F.col("verdict") == "200/OK", F.col("ordinal"))).alias("best"))
    verdict = F.when(F.col("s") == 1, "skipped").when(F.col("o") == 1, "served").when(F.col("c") == 1, "challenge").when(F.col("b") == 1, "refused").otherwise("no fields")
    return seen.select("site", verdict.alias("verdict"), "best")


def payload(body: Column, strategy: str) -> Column:
    """The JSON text that a page carries: api_json, next_data, or jsonld (several blocks become an array)."""
    if strategy == "api_json":
        return body
    kind = r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>' if strategy == "next_data" else r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
    if strategy == "next_data":
        return F.nullif(F.regexp_extract(body, kind, 1), F.lit(""))
    blocks = F.regexp_extract_all(body, F.lit(kind), F.lit(1))
    return F.when(F.size(blocks) == 1, F.element_at(blocks, 1)).when(F.size(blocks) > 1, F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]")))


PATH_STEP = re.compile(r"\.([A-Za-z_][\w-]*)|\[(\d+)\]|\['([^']*)'\]|\[\*\]")


def path_steps(path: str) -> list[str | None]:
    """A JSON path as its parts between ``[*]`` steps, each a path from ``$``; None stands for ``[*]``."""
    steps: list[str | None] = []
    at = 1
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path}")
    while at < len(path):
        found = PATH_STEP.match(path, at)
        if not found:
            raise ValueError(f"not a path of .name, [n], ['name'] and [*]: {path}")
        name, index, quoted = found.groups()
        if found[0] == "[*]":
            steps.append(None)
        else:
            step = f"[{index}]" if index is not None else f'["{name if name is not None else quoted}"]'
            if steps and steps[-1] is not None:
                steps[-1] += step
            else:
                steps.append("$" + step)
        at = found.end()
    return steps


def _elements(v: Column) -> Column:
    """A list's elements, or the value itself as the only one."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def _at(step: str) -> Callable[[Column], Column]:
    return lambda v: F.try_variant_get(v, step, "variant")


def path_values(v: Column, path: str) -> Column:
    """All values that a path finds in a variant, in order; ``[*]`` steps into each element of a list."""
    found = F.array(v)
    for step in path_steps(path):
        if step is None:
            found = F.flatten(F.transform(found, _elements))
        else:
            found = F.filter(F.transform(found, _at(step)), lambda x: x.isNotNull())
    return found


def json_rows(pages: DataFrame, body: str, strategy: str, root: str, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """A row for each value that ``root`` finds, lists among them flattened one level, with scalar ``fields`` by path (the
    first value found); containers and missing paths are null, a body that isn't JSON gives no rows.

    Paths are made of .name, [n], ['name'] and [*]."""
    v = pages.withColumn("v", F.try_parse_json(payload(F.col(body), strategy)))
    v = v.where(F.col("v").isNotNull()).withColumn("item", F.explode(F.flatten(F.transform(path_values(F.col("v"), root), _elements))))

    def first(path: str) -> Column:
        if None in path_steps(path):
            found = F.try_element_at(path_values(F.col("item"), path), F.lit(1))
        else:
            found = F.try_variant_get("item", "".join(s for s in path_steps(path) if s) or "$", "variant")
        scalar = ~F.schema_of_variant(found).startswith("OBJECT") & ~F.schema_of_variant(found).startswith("ARRAY")
        return F.when(scalar, F.try_variant_get(found, "$", "string"))

    return v.select(*keys, *[first(path).alias(name) for name, path in fields.items()])


class Tree(HTMLParser):
    """Elements as [tag, attributes, children, text parts, parent]; a void element has no children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, [], [], None]
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), [], [], self.at]
        self.at[2].append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at[2].append([tag, dict(attrs), [], [], self.at])

    def handle_endtag(self, tag):
        node = self.at
        while node[4] is not None and node[0] != tag:
            node = node[4]
        if node[4] is not None:
            self.at = node[4]

    def handle_data(self, data):
        self.at[3].append(data)
        self.at[2].append(data)


def parse(html: str) -> list:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def walk(node: list) -> Iterator[list]:
    """Elements below a node in document order, however deep."""
    left = [c for c in reversed(node[2]) if not isinstance(c, str)]
    while left:
        child = left.pop()
        yield child
        left += [c for c in reversed(child[2]) if not isinstance(c, str)]


SELECTOR = re.compile(r"([\w-]+)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:(\^?=)[\"']?([^\"'\]]*)[\"']?)?\]")


def selects(node: list, selector: str) -> bool:
    """Compound selectors of tag, .class, #id, [a], [a=v] and [a^=v]; commas separate alternatives."""

    def one(part: str) -> bool:
        for tag, cls, id_, name, op, value in SELECTOR.findall(part.strip()):
            have = node[1].get(name)
            if tag and node[0] != tag or cls and cls not in (node[1].get("class") or "").split() or id_ and node[1].get("id") != id_:
                return False
            if name and (name not in node[1] or op == "=" and have != value or op == "^=" and not (have or "").startswith(value)):
                return False
        return True

    return any(map(one, selector.split(",")))


def text_of(node: list) -> str:
    said, left = [], list(reversed(node[2]))
    while left:
        c = left.pop()
        if isinstance(c, str):
            said.append(c)
        else:
            said.append(" ")
            left += [" ", *reversed(c[2])]
    return re.sub(r"\s+", " ", "".join(said)).strip()


def field(item: list, rule: dict) -> str | None:
    """The value of one rule inside an item: const, sel (with attr, true_if, false_if) or label, then regex."""
    if rule.get("const") is not None:
        return rule["const"]
    node = None
    if rule.get("label"):
        for cell in walk(item):
            if selects(cell, rule.get("label_in") or "td,th,dt") and text_of(cell).lower().startswith(rule["label"].strip().lower()):
                beside = [c for c in cell[4][2] if not isinstance(c, str) and c is not cell and selects(c, rule.get("value_in") or "td,dd")]
                if beside:
                    node = beside[-1]
                    break
    elif rule.get("sel") == "self":
        node = item
    elif rule.get("sel"):
        node = next((n for n in walk(item) if selects(n, rule["sel"])), None)
    if node is None:
        return None
    for key, answer in (("false_if", "false"), ("true_if", "true")):
        if rule.get(key) and any(selects(n, rule[key]) for n in walk(node)):
            return answer
    if rule.get("true_if") or rule.get("false_if"):
        return None
    value = node[1].get(rule["attr"]) if rule.get("attr") else text_of(node)
    if value is not None and rule.get("regex"):
        found = re.search(rule["regex"], value)
        value = None if not found else found.group(1) if found.groups() else found.group(0)
    return (re.sub(r"\s+", " ", value).strip() or None) if value is not None else None


ITEMS = "array<map<string,string>>"
LAYOUT = "struct<fingerprint:string,signature:string>"
REDUCED = "struct<reduced:string,in_chars:long,out_chars:long,text_dropped:long,urls_dropped:long,icons_kept:long>"


def items_of(root: list, item: str, rules: dict[str, dict]) -> list[dict[str, str]]:
    """The fields of each element of a parsed page that ``item`` selects, without those that aren't there."""
    return [{name: v for name, r in rules.items() if (v := field(n, r)) is not None} for n in walk(root) if selects(n, item)]


def layout_of(root: list, item: str) -> dict[str, str]:
    found = [n for n in walk(root) if selects(n, item)]
    told = "dom:" + "|".join(sorted({_signature(n, DOM_DEPTH) for n in found})) if found else "dom:no-match"
    return {"fingerprint": hashlib.sha1(told.encode()).hexdigest()[:16], "signature": told[:2000]}


def reduced_of(root: list, html: str, limit: int) -> dict:
    got = _Reduced(root, limit)
    return {"reduced": got.body, "in_chars": len(html), "out_chars": len(got.body) - 1, "text_dropped": got.text, "urls_dropped": got.urls, "icons_kept": got.icons}


def read_pages(pages: DataFrame, key: str, body: str, item: str | None = None, rules: dict[str, dict] | None = None, layout_item: str | None = None, text_limit: int | None = None) -> DataFrame:
    """(key, items, layout, reduced, error): all that is asked for (the rest is null) from one parse of each page.

    A null body is an empty page. A page that can't be read has nulls and its error, and the others go on.
    """
    import pyarrow as pa

    kinds = pa.struct([("items", pa.list_(pa.map_(pa.string(), pa.string()))), ("layout", pa.struct([("fingerprint", pa.string()), ("signature", pa.string())])),
                       ("reduced", pa.struct([("reduced", pa.string()), *((c, pa.int64()) for c in ("in_chars", "out_chars", "text_dropped", "urls_dropped", "icons_kept"))])), ("error", pa.string())])

    def read(html: str) -> dict:
        try:
            root = parse(html)
            return {
                "items": [list(f.items()) for f in items_of(root, item, rules or {})] if item is not None else None, "layout": layout_of(root, layout_item) if layout_item is not None else None,
                "reduced": reduced_of(root, html, text_limit) if text_limit is not None else None, "error": None,
            }
        except Exception as error:  # noqa: BLE001 - one bad page is a row of its own
            return {"items": None, "layout": None, "reduced": None, "error": f"{type(error).__name__}: {error}"[:500]}

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):  # a page may be megabytes, its tree many times that
                part = batch.slice(begin, 200)
                found = pa.array([read(html.as_py() or "") for html in part["body"]], kinds)
                yield pa.RecordBatch.from_arrays([part["key"], *found.flatten()], ["key", *(f.name for f in kinds)])

    rows = pages.select(F.col(key).alias("key"), F.col(body).alias("body"))
    return rows.mapInArrow(run, f"key {dict(pages.dtypes)[key]}, items {ITEMS}, layout {LAYOUT}, reduced {REDUCED}, error string").withColumnRenamed("key", key)


def extract(pages: DataFrame, key: str, body: str, item: str, rules: dict[str, dict]) -> DataFrame:
    """(key, ordinal, fields map, error): a row for each element that ``item`` selects, or one with a page's error."""
    read = read_pages(pages, key, body, item=item, rules=rules)
    none = F.array(F.create_map().cast("map<string,string>"))
    rows = read.select(key, "error", F.posexplode(F.when(F.col("error").isNotNull(), none).otherwise(F.col("items"))).alias("ordinal", "fields"))
    return rows.select(key, "ordinal", "fields", "error")


def _signature(node: list, depth: int) -> str:
    classes = sorted(c for c in (node[1].get("class") or "").split() if not VOLATILE.fullmatch(c))
    data = sorted(a for a in node[1] if a.startswith("data-"))
    own = node[0] + ("." + ".".join(classes) if classes else "") + (f"[{','.join(data)}]" if data else "")
    below = sorted({_signature(c, depth - 1) for c in node[2] if not isinstance(c, str)}) if depth else []
    return f"{own}({','.join(below)})" if below else own


def layout(pages: DataFrame, key: str, body: str, item: str = "body") -> DataFrame:
    """(key, fingerprint, signature, error) of each page's structure below ``item``, blind to text and layout utility classes."""
    return read_pages(pages, key, body, layout_item=item).select(key, "layout.*", "error")


def drift(fingerprints: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows whose fingerprint differs from the one before."""
    before = F.lag("fingerprint").over(Window.partitionBy(*by).orderBy(order))
    return fingerprints.withColumn("previous", before).where(F.col("previous") != F.col("fingerprint"))


class _Reduced:
    """A page's structure without prose and urls, with counts of what went."""

    def __init__(self, root: list, limit: int) -> None:
        self.limit, self.out, self.text, self.urls, self.icons = limit, [], 0, 0, 0
        self.visit(root)
        self.body = "".join(self.out).replace("><", ">\n<") + "\n"

    def visit(self, node: list) -> None:
        left: list = [(c, False) for c in reversed(node[2])]
        while left:
            child, closing = left.pop()
            if closing:
                self.out.append(f"</{child}>")
            elif isinstance(child, str):
                if said := re.sub(r"\s+", " ", child).strip():
                    self.text += len(said) > self.limit
                    self.out.append(PLACEHOLDER if len(said) > self.limit else said)
            elif child[0] not in DROPPED:
                self.out.append(f"<{child[0]}{''.join(self.attribute(*a) for a in child[1].items())}>")
                left += [] if child[0] in VOID else [(child[0], True)]
                left += [(c, False) for c in reversed(child[2])]

    def attribute(self, name: str, value: str | None) -> str:
        if name in FRAGMENT_ATTRIBUTES and (value or "").startswith("#"):
            self.icons += 1
            return f' {name}="{value}"'
        if name in URL_ATTRIBUTES or name in FRAGMENT_ATTRIBUTES:
            self.urls += 1
            return ""
        keep = name in KEPT_ATTRIBUTES or name.startswith("data-")
        return (f' {name}="{value.strip()}"' if value else f" {name}") if keep else ""


def reduce_html(pages: DataFrame, key: str, body: str, text_limit: int = TEXT_LIMIT) -> DataFrame:
    """(key, reduced, in_chars, out_chars, text_dropped, urls_dropped, icons_kept, error)."""
    return read_pages(pages, key, body, text_limit=text_limit).select(key, "reduced.*", "error")


# Discovery ----------------------------------------------------------------------------------------------------------


def index_plan(locations: DataFrame, mode: str, pattern: str, sweep_pages: int = 4, page_size: int = 24) -> DataFrame:
    """(code, page, url): one page a location when hot, ``sweep_pages`` in a sweep."""
    pages = locations.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit((sweep_pages if mode == "sweep" else 1) - 1))))
    return pages.select("code", "page", F.format_string(pattern, F.col("code"), F.col("page") * page_size).alias("url"))


def sitemap_urls(bodies: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """Every <loc> of the sitemaps, with kind child (a listings sitemap), listing or other, and the id in a listing's path."""
    url = bodies.select(*keys, F.explode(F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    listing = F.nullif(F.regexp_extract("url", r"/property-to-rent/.*/(\d+)/?$", 1), F.lit(""))
    kind = F.when(F.col("url").endswith(".xml") & F.col("url").contains("listings"), "child").when(listing.isNotNull(), "listing").otherwise("other")
    return url.select("*", kind.alias("kind"), listing.alias("external_id"))


def new_tasks(urls: DataFrame, known: DataFrame, scope: list[str], outward: Column) -> DataFrame:
    """Urls of ids not yet known whose district is in scope or unknown; one a key (id, else url), the first by ordinal."""
    fresh = urls.join(known.select("source_key", "external_id"), ["source_key", "external_id"], "left_anti").where(outward.isNull() | outward.isin(scope))
    first = fresh.groupBy(F.coalesce("external_id", "url").alias("task")).agg(F.min_by(F.struct(*[c for c in fresh.columns]), "ordinal").alias("r"))
    return first.select("r.*")


def narrow_scope(enabled: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requested codes that are enabled, requested codes that aren't), upper-cased."""
    codes = requested.select(F.upper(F.trim("code")).alias("code")).distinct()
    have = enabled.select(F.upper("code").alias("code")).distinct()
    return codes.join(have, "code", "left_semi"), codes.join(have, "code", "left_anti")


def changed(now: DataFrame, before: DataFrame, key: str, body: str) -> DataFrame:
    """Pages whose (key, content hash) the previous snapshot doesn't have."""
    hashed = lambda df: df.withColumn("content", F.sha2(F.coalesce(F.col(body), F.lit("")), 256))
    return hashed(now).join(hashed(before).select(key, "content"), [key, "content"], "left_anti")


def sitemap_plan(index: str, children: list[str], mode: str, spark) -> DataFrame:
    """(url, kind): the sitemap index, in a sweep also the children that are known by name."""
    rows = [(index, "index"), *((c, "child") for c in children if mode == "sweep")]
    return spark.createDataFrame(rows, "url string, kind string")


def follow_children(entries: DataFrame, bodies: DataFrame, body: str) -> DataFrame:
    """Entries of the child sitemaps that ``entries`` (url, kind) name, one level down, by their bodies (url, body)."""
    named = entries.where(F.col("kind") == "child").select("url").distinct()
    return sitemap_urls(bodies.join(named, "url").withColumnRenamed("url", "parent"), body, ["parent"])


#: Rules of result cards on a search page: the id in the anchor's name, the address.
CARD_RULES = {"external_id": {"sel": "a[id^=prop]", "attr": "id", "regex": r"prop(\d+)"}, "address_raw": {"sel": "address"}}


def card_tasks(cards: DataFrame, known: DataFrame, scope: list[str], base: str) -> DataFrame:
    """(external_id, url) of result cards (external_id, address_raw) that aren't known and whose address names a district
    in scope, or none; one a listing."""
    from ..functions.geo import outward_from_address

    outward = outward_from_address(F.coalesce("address_raw", F.lit("")))
    fresh = cards.where(F.coalesce("external_id", F.lit("")) != "").join(known.select("external_id"), "external_id", "left_anti").where(outward.isNull() | outward.isin(scope))
    return fresh.select("external_id").distinct().withColumn("url", listing_url(base, F.col("external_id")))


def listing_url(base: str, external_id: Column) -> Column:
    return F.concat(F.lit(f"{base}/properties/"), external_id)


def first_link(body: Column, pattern: str, base: str) -> Column:
    """The first part of the body that looks like a listing's link, made absolute; null without one."""
    found = F.regexp_substr(body, F.lit(pattern))
    return F.when(found.startswith("http"), found).otherwise(F.concat(F.lit(base), found))


def failures(results: DataFrame) -> DataFrame:
    """Responses (target, status, body_len, verdict, ordinal) that were tried and didn't succeed, one of a kind."""
    bad = results.where(~F.col("verdict").startswith("200/OK") & (F.col("verdict") != "SKIPPED(robots)"))
    return bad.groupBy("target", "status", "body_len").agg(F.min_by("verdict", "ordinal").alias("verdict"), F.min("ordinal").alias("ordinal"))


def markers(body: Column, tokens: tuple[str, ...], link: str) -> Column:
    """Struct (found, links): which tokens the whole body has, in order, and how many parts look like a listing's link."""
    low = F.lower(body)
    found = F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in tokens]), lambda x: x.isNotNull())
    return F.struct(found.alias("found"), F.size(F.regexp_extract_all(body, F.lit(link), F.lit(0))).alias("links"))


def dropped_tasks(urls: DataFrame) -> DataFrame:
    """How many urls repeat a task (id, else url)."""
    return urls.agg((F.count(F.lit(1)) - F.count_distinct(F.coalesce("external_id", "url"))).alias("dropped"))
