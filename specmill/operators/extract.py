"""Links, media, specifications and product records from pages, and sizes from document texts.

Links and media come from tag patterns inside Spark expressions, per page and without a shuffle. Specifications and product
cards need nesting: one function reads a page once, as a stream of markup events, for both.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mining, web
from ..functions.text import c, js_trim
from .tidy import top_k

PAGE = ["page_id", "url"]

# fixed values: words that tell a document link by its address, or by its text
DOC_ADDRESS_WORDS = ("datasheet", "manual", "brochure", "specification", "catalog")
DOC_TEXT_WORDS = ("Download", "PDF", "Datasheet", "Manual")


def host(url) -> Column:
    return F.regexp_extract(c(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1)


def extract_links(pages: DataFrame, k: int | None = None, words: tuple[str, ...] = (), same_site: bool = True) -> DataFrame:
    """Distinct links of a page (with k the first k): absolute, of the same site, no fragments or scripts, in page order.
    ``words`` keeps links whose raw address contains one of them. Works within the row, without a shuffle."""
    hrefs = F.transform(web.anchors("html"), lambda a: web.attr(F.regexp_extract(a, r"(?s)^<a\b[^>]*>", 0), "href"))
    ok = F.filter(hrefs, lambda h: h.isNotNull() & ~h.startswith("#") & ~h.startswith("javascript"))
    if words:
        ok = F.filter(ok, lambda h: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: h.contains(w)))
    full = F.array_compact(F.array_distinct(F.transform(ok, lambda h: web.absolute_url(h, c("url")))))
    if same_site:
        full = F.filter(full, lambda u: u.contains(host("url")))
    if k is not None:
        full = F.slice(full, 1, k)
    return pages.select(*PAGE, F.posexplode(full).alias("i", "link")).select(*PAGE, (c("i") + 1).alias("rank"), "link")


def _elements(pages: DataFrame, found: Column, name: str) -> DataFrame:
    return pages.select(*PAGE, F.posexplode(found).alias("pos", name))


def _first_of(items: Column, field: str) -> Column:
    """The items without those whose ``field`` an earlier one has."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, lambda y: y[field]), x[field]) == i + 1)


def _held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _listed(found: Column, k: int | None) -> Column:
    """Items with an address, the first per address; with k the first k of them."""
    kept = _held(F.filter(found, lambda x: x["link"].isNotNull()), lambda x: _first_of(x, "link"))
    return kept if k is None else F.slice(kept, 1, k)


def doc_links() -> Column:
    """Document links of a page as an array of (link, type, title, pos), one per address."""
    def one(a, i):
        tag, text = F.regexp_extract(a, r"(?s)^<a\b[^>]*>", 0), web.tag_text(a)
        return F.struct(web.attr(tag, "href").alias("href"), text.alias("text"), web.attr(tag, "title").alias("tip"), i.alias("pos"))

    def is_doc(d):
        h, t = F.lower(d["href"]), F.lower(d["text"])
        named = lambda x, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: x.contains(w))
        return d["href"].isNotNull() & (h.contains("pdf") | t.contains("pdf") | t.contains("download")) & (
            h.endswith(".pdf") | named(d["href"], DOC_ADDRESS_WORDS)
            | named(d["text"], DOC_TEXT_WORDS))

    def doc(d):
        return F.struct(web.absolute_url(d["href"], c("url")).alias("link"), web.doc_type(d["href"], d["text"]).alias("type"),
                        F.coalesce(F.nullif(d["text"], F.lit("")), d["tip"], web.file_name(d["href"])).alias("title"), d["pos"].alias("pos"))

    return _listed(F.transform(F.filter(F.transform(web.anchors("html"), one), is_doc), doc), None)


def extract_doc_links(pages: DataFrame) -> DataFrame:
    """Document links with type and title, one per address."""
    return pages.select(*PAGE, F.inline(doc_links())).select(*PAGE, "pos", "link", "type", "title")


def image_links(mode: str = "small", k: int | None = None) -> Column:
    """Images of a page after the skip rule as an array of (link, alt, title, pos), absolute and distinct; with k the first k."""
    def one(t, i):
        blank = lambda n: F.coalesce(web.attr(t, n), F.lit(""))
        alt = F.coalesce(F.nullif(blank("alt"), F.lit("")), blank("title")) if mode == "page" else blank("alt")
        return F.struct(F.coalesce(web.attr(t, "src"), web.attr(t, "data-src"), web.attr(t, "data-lazy-src")).alias("src"), web.parse_int(web.attr(t, "width")).alias("w"),
                        web.parse_int(web.attr(t, "height")).alias("h"), alt.alias("alt"), blank("title").alias("title"), i.alias("pos"))

    def shown(x):
        ok = x["src"].isNotNull() & ~web.skip_image(x["src"], x["w"], x["h"], mode)
        return ok & x["src"].startswith("http") & (x["w"] >= 100) & (x["h"] >= 100) if mode == "strict" else ok

    def image(x):
        return F.struct(web.absolute_url(x["src"], c("url")).alias("link"), x["alt"].alias("alt"), x["title"].alias("title"), x["pos"].alias("pos"))

    return _listed(F.transform(F.filter(F.transform(web.tags("html", "img"), one), shown), image), k)


def extract_images(pages: DataFrame, mode: str = "small", k: int | None = None) -> DataFrame:
    """Images of a page after the skip rule, absolute and distinct; with k the first k."""
    return pages.select(*PAGE, F.inline(image_links(mode, k))).select(*PAGE, "pos", "link", "alt", "title")


def video_links() -> Column:
    """Videos of a page as an array of (type, url, embed, id): YouTube and Vimeo players, then video files."""
    srcs = F.transform(web.tags("html", "iframe"), lambda t: web.video_ref(F.coalesce(web.attr(t, "src"), web.attr(t, "data-src"))))
    players = F.filter(srcs, lambda v: v["id"].isNotNull())
    of = lambda kind: F.filter(players, lambda v: v["type"] == kind)
    none = F.lit(None).cast("string")
    files = F.transform(F.filter(F.transform(_video_tags(), lambda t: web.attr(t, "src")), lambda x: x.isNotNull()), lambda x: F.struct(
        F.lit("mp4").alias("type"), web.absolute_url(x, c("url")).alias("url"), none.alias("embed"), none.alias("id")))
    return F.concat(of("youtube"), of("vimeo"), files)


def _video_tags() -> Column:
    """<video> tags and the <source> tags inside them; the blocks are cut out first."""
    blocks = F.regexp_extract_all(web.visible_html("html"), F.lit(r"(?is)<video\b.*?(?:</video\s*>|$)"), F.lit(0))
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?is)<(?:source|video)\b[^>]*>"), F.lit(0))))


def extract_videos(pages: DataFrame) -> DataFrame:
    """Embedded players (YouTube, then Vimeo), then video files: (page_id, kind_rank, pos, type, video_url, embed, id)."""
    srcs = F.transform(web.tags("html", "iframe"), lambda t: F.coalesce(web.attr(t, "src"), web.attr(t, "data-src")))
    players = (_elements(pages, srcs, "src").withColumn("v", web.video_ref("src")).filter("v.id is not null")
               .select("page_id", F.when(c("v.type") == "youtube", 0).otherwise(1).alias("kind_rank"), "pos", c("v.type").alias("type"),
                       c("v.url").alias("video_url"), c("v.embed").alias("embed"), c("v.id").alias("id")))
    none = F.lit(None).cast("string")
    files = (_elements(pages, F.transform(_video_tags(), lambda t: web.attr(t, "src")), "src").filter("src is not null")
             .select("page_id", F.lit(2).alias("kind_rank"), "pos", F.lit("mp4").alias("type"),
                     web.absolute_url("src", c("url")).alias("video_url"), none.alias("embed"), none.alias("id")))
    return players.unionByName(files)


def extract_badges(pages: DataFrame) -> DataFrame:
    """Certification badges (image texts) and data sheets of a page, as (page_id, kind, pos, value, title)."""
    alts = F.filter(F.transform(web.tags("html", "img"), lambda t: web.attr(t, "alt")),
                    lambda a: a.contains("CE") | a.contains("ISO") | a.contains("UL") | a.contains("certified"))
    badges = _elements(pages, alts, "value").select("page_id", F.lit("certification").alias("kind"), "pos", "value",
                                                    F.lit(None).cast("string").alias("title"))
    a = _elements(pages, web.anchors("html"), "a")
    href, text = web.attr(F.regexp_extract("a", r"(?s)^<a\b[^>]*>", 0), "href"), web.tag_text("a")
    t = F.lower(text)
    sheets = (a.filter(href.endswith(".pdf") & (t.contains("datasheet") | t.contains("spec") | t.contains("brochure")))
              .select("page_id", F.lit("datasheet").alias("kind"), "pos", web.absolute_url(href, c("url")).alias("value"), text.alias("title")))
    return badges.unionByName(sheets)


def _heading() -> Column:
    h1 = web.tag_text(F.regexp_extract(web.visible_html("html"), r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    return F.regexp_replace(h1, r"\s+", " ")


def _model_of(heading: str) -> Column:
    return js_trim(F.regexp_replace(F.regexp_replace(heading, "(?i)electric chain hoist", ""), "(?i)chain hoist", ""))


def page_titles(pages: DataFrame) -> DataFrame:
    """Model name from the first h1; pages without one of at least two characters drop out."""
    return pages.select(*PAGE, _heading().alias("_h1")).filter(F.length("_h1") >= 2).select(*PAGE, _model_of("_h1").alias("model"))


def product_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(web.has_product_content("html"))


# -- nested structures --------------------------------------------------------------------------------------------

# fixed values of the markup language: elements without content, and what a start tag closes
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
          "p": {"p"}, "option": {"option"}}

#: What fills a slot of a container, given (tag, class attribute). The first filled element counts.
SLOTS = {
    "row": {"cells": lambda t, k: t in ("td", "th")},
    "list": {"terms": lambda t, k: t in ("dt", "dd")},
    "block": {"label": lambda t, k: "label" in k or t in ("strong", "b"), "value": lambda t, k: "value" in k},
    "card": {"title": lambda t, k: t in ("h2", "h3", "h4") or bool({"title", "name"} & set(k.split())), "link": lambda t, k: t == "a",
             "text": lambda t, k: t == "p" or bool({"description", "text"} & set(k.split()))},
}


class _Open:
    """An element under way: its own text where someone waits for it, and the container it is, if any."""

    __slots__ = ("tag", "text", "into", "kind", "slots", "images", "order")

    def __init__(self, tag: str):
        self.tag, self.text, self.into, self.kind, self.slots, self.images, self.order = tag, None, [], None, {}, [], 0


class PageReader(HTMLParser):
    """Specifications and cards of one page, read as events: text goes to the open elements that someone waits for."""

    def __init__(self, card: str):
        super().__init__(convert_charrefs=True)
        self.card, self.open, self.hidden, self.seen, self.found, self.cards = card, [], 0, 0, [], []

    def _kind(self, tag: str, k: str) -> str | None:
        if tag == "tr":
            return "row"
        if tag == "dl":
            return "list"
        if self.card in k.split():
            return "card"
        return "block" if "spec" in k or "feature" in k else None

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1].tag in CLOSES.get(tag, ()):
            self._end()
        attrs = dict(attrs)
        k = attrs.get("class") or ""
        self.seen += 1
        if tag == "img":
            src = attrs.get("src") or attrs.get("data-src")
            if src and "icon" not in src and "logo" not in src:
                for e in self.open:
                    if e.kind == "card":
                        e.images.append({"src": src, "alt": attrs.get("alt") or ""})
        if tag in VOID:
            return
        e = _Open(tag)
        e.order = self.seen
        for holder in self.open:
            for slot, test in SLOTS.get(holder.kind, {}).items():
                if test(tag, k):
                    e.into.append((holder, slot))
        e.kind = self._kind(tag, k)
        if e.into or e.kind == "block":
            e.text = []
        self.hidden += tag in ("script", "style")
        self.open.append(e)

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            for e in self.open:
                if e.text is not None:
                    e.text.append(data)

    def _end(self) -> str:
        e = self.open.pop()
        self.hidden -= e.tag in ("script", "style")
        text = "".join(e.text) if e.text is not None else ""
        for holder, slot in e.into:
            holder.slots.setdefault(slot, []).append((e.order, e.tag, text.strip()))
        if e.kind:
            self._done(e, text)
        return e.tag

    def _done(self, e: _Open, text: str) -> None:
        slots = {k: sorted(v) for k, v in e.slots.items()}
        first = {k: v[0][2] for k, v in slots.items()}
        if e.kind == "row":
            cells = [x[2] for x in slots.get("cells", [])]
            if len(cells) > 1 and cells[0] and cells[1]:
                self.found.append((0, e.order, cells[0], cells[1]))
        elif e.kind == "list":
            terms = slots.get("terms", [])
            self.found += [(1, a[0], a[2], b[2]) for a, b in zip(terms, terms[1:]) if (a[1], b[1]) == ("dt", "dd") and a[2] and b[2]]
        elif e.kind == "block":
            label = first.get("label", "")
            value = first.get("value") or text.replace(label, "", 1).strip()
            if label and value:
                self.found.append((2, e.order, label, value))
        elif e.kind == "card":
            title = first.get("title") or first.get("link", "")
            if len(title) > 2:
                self.cards.append((e.order, {"model": title, "description": first.get("text") or None, "images": e.images}))

    def finish(self) -> tuple[list[dict], list[dict]]:
        """Specifications (tables, then lists, then labelled blocks; the last of a name counts) and cards in page order."""
        while self.open:
            self._end()
        specs = {}
        for _, _, label, value in sorted(self.found):
            specs[label.lower()] = value
        return [{"key": k, "value": v} for k, v in specs.items()], [x for _, x in sorted(self.cards, key=lambda x: x[0])]


def read_page(html: str | None, card: str = "product") -> tuple[list[dict], list[dict]]:
    reader = PageReader(card)
    reader.feed(html or "")
    reader.close()
    return reader.finish()


READ = "specs array<struct<key:string,value:string>>, cards array<struct<model:string,description:string,images:array<struct<src:string,alt:string>>>>"


def with_parsed(pages: DataFrame, card: str = "product") -> DataFrame:
    """Pages with ``specs`` (a map) and ``cards``; a page is parsed once and stays one row.

    Pages go to Python by the hundred, not in Arrow batches of up to 10,000, so memory does not grow with a task's rows.
    """
    parsed = F.udf(lambda html: read_page(html, card), READ, useArrow=False)
    return pages.withColumn("_p", parsed("html")).withColumns({"specs": F.map_from_entries("_p.specs"), "cards": F.col("_p.cards")}).drop("_p")


def extract_specs(pages: DataFrame) -> DataFrame:
    """(page_id, specs map) for every page: table rows, definition lists and labelled blocks."""
    return with_parsed(pages).select("page_id", "specs")


def register_page_specs(spark: SparkSession, name: str = "page_specs") -> None:
    """Table function for SQL: ``SELECT ... FROM pages, LATERAL page_specs(html)`` gives (key, value) of each specification of a page.

    The same as ``extract_specs``, a row for each; a null or empty page has none.
    """
    @F.udtf(returnType="key string, value string", useArrow=True)
    class PageSpecs:
        def eval(self, html: str):
            for s in read_page(html)[0]:
                yield s["key"], s["value"]

    spark.udtf.register(name, PageSpecs)


def extract_parsed_specs(pages: DataFrame) -> DataFrame:
    return extract_specs(pages).select("page_id", "specs", mining.map_specs("specs").alias("parsed"))


def extract_cards(pages: DataFrame, css_class: str = "product") -> DataFrame:
    """Product cards of listing pages with absolute image addresses."""
    cards = with_parsed(pages, css_class).select(*PAGE, F.posexplode("cards").alias("pos", "_c")).select(*PAGE, "pos", "_c.*")
    return cards.withColumn("images", F.transform("images", lambda i: F.struct(web.absolute_url(i["src"], c("url")).alias("url"), i["alt"].alias("alt"))))


def extract_product(pages: DataFrame, manufacturer=None) -> DataFrame:
    """One record per product page: model, vendor, description, media, raw and parsed specifications.

    ``manufacturer`` is the vendor's name or a column; NULL without it. One pass over a page, no join and no shuffle, so pages that
    share an id stay apart.
    """
    block = F.regexp_extract(web.visible_html("html"), r"(?is)class\s*=\s*[\"'][^\"']*\bdescription\b[^\"']*[\"'][^>]*>(.*?)</(?:p|div|section|span)\s*>", 1)
    vendor = F.lit(manufacturer).cast("string") if manufacturer is None or isinstance(manufacturer, str) else manufacturer
    images = F.transform(image_links("page"), lambda i: F.struct(i["link"].alias("url"), i["alt"].alias("alt")))
    pdfs = F.transform(doc_links(), lambda d: F.struct(d["link"].alias("url"), d["title"].alias("title"), d["type"].alias("type")))
    titled = pages.withColumn("_h1", _heading()).filter(F.length("_h1") >= 2)
    return with_parsed(titled).withColumn("parsed", mining.map_specs("specs")).select(
        *PAGE, _model_of("_h1").alias("model"), vendor.alias("manufacturer"), F.nullif(web.tag_text(block), F.lit("")).alias("description"),
        images.alias("images"), video_links().alias("videos"), pdfs.alias("pdfs"), c("url").alias("scrapedFrom"), c("specs").alias("rawSpecifications"), "parsed.*")


def page_text_specs(pages: DataFrame) -> DataFrame:
    """Labelled specifications in the running text of a page."""
    low = pages.select(*PAGE, web.body_text("html").alias("_t")).withColumn("_low", F.lower("_t"))
    return low.select(*PAGE, mining.mine_specs("_t", low="_low").alias("s")).select(*PAGE, "s.*")


# -- documents ----------------------------------------------------------------------------------------------------

def _mined(df: DataFrame) -> DataFrame:
    """Sizes ``d`` and weights ``w`` of the text column ``_t``; the lower-case text is made once for all tests."""
    low = df.withColumn("_low", F.lower("_t"))
    return low.withColumns({"d": mining.mine_dimensions("_t", low="_low"), "w": mining.mine_weights("_t", low="_low")})


def mine_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every size and weight expression as rows (key, kind, i, value), whole texts, one pass, no shuffle."""
    found = _mined(docs.select(key, c(text).alias("_t"))).select(key, "d", "w")
    item = lambda kind, col: F.transform(col, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), v.alias("value")))
    return found.select(key, F.inline(F.concat(item("dimension", "d"), item("weight", "w"))))


def mined_by_product(docs: DataFrame, product: str, pos: str, text: str = "text") -> DataFrame:
    """Mined expressions per product: count per kind and the best size and weight, from all of its documents.

    Best values are reduced per document first and then by max / min aggregates, so a product with very many documents
    is not collected anywhere.
    """
    m = _mined(docs.select(product, pos, c(text).alias("_t"))).drop("_t", "_low")
    # no filter here: it would be pushed below the mining and do it a second time
    found = (F.size("d") > 0) | (F.size("w") > 0)
    kg = lambda x: F.filter(x, lambda w: w.rlike(r"(?i)\d+(?:\.\d+)?\s*kg"))
    best_kg = mining.longest(kg(c("w")))
    best_d = mining.best_dimension("d")
    order = lambda v: F.when(v.isNotNull(), F.struct(F.length(v), -c(pos)))
    return m.groupBy(product).agg(
        F.sum(F.size("d")).alias("n_dimensions"), F.sum(F.size("w")).alias("n_weights"), F.count_if(found).alias("n_docs"),
        F.max_by(best_d, order(best_d)).alias("dimension"),
        F.coalesce(F.max_by(best_kg, order(best_kg)),
                   F.min_by(F.try_element_at("w", F.lit(1)), F.when(F.size("w") > 0, c(pos)))).alias("weight")
    ).filter("n_docs > 0")


def doc_specs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    low = docs.select(key, c(text).alias("_t")).withColumn("_low", F.lower("_t"))
    return low.select(key, mining.mine_specs("_t", low="_low").alias("s")).select(key, "s.*")
