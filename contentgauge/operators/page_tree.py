"""Pages as element trees: a small parser makes one row of intervals for each page, column expressions do the rest.

elements are in page order. Element k holds the elements from k + 1 to before its end, and the text runs from its first
to before its last; so whatever an element contains is a slice, and no page is parsed twice or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset("script style template".split())
#: What an opening tag closes, up to the nearest element of the second list.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
} | dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ({"p"}, {"td", "th", "li", "button", "svg"}))
_ELEMENT = pa.struct([("pos", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("classes", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("first", pa.int32()), ("last", pa.int32()), ("raw_first", pa.int32()), ("raw_last", pa.int32())])
SCHEMA = "page_id bigint, url string, elements array<struct<pos:int,end:int,parent:int,tag:string,classes:string,attrs:map<string,string>,first:int,last:int,raw_first:int,raw_last:int>>, runs array<string>, raw string"


class _Tree(HTMLParser):
    """Element 0 stands for the page. Scripts, styles, templates and comments have no text; text without content is no run."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements, self.runs, self.raw, self.n_raw, self.data = [], [], [], 0, []
        self.open: list[int] = []
        self._open("#document", [])

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {}
        for name, value in attrs:
            found.setdefault(name, value or "")
        at = {"pos": len(self.elements), "end": 0, "parent": self.open[-1] if self.open else -1, "tag": tag, "classes": " ".join(found.get("class", "").split()), "attrs": list(found.items())}
        self.open.append(at["pos"])
        self.elements.append(at | {"first": len(self.runs), "last": 0, "raw_first": self.n_raw, "raw_last": 0})

    def _flush(self) -> None:
        if not self.data:
            return
        text, self.data = "".join(self.data), []
        if any(self.elements[k]["tag"] in _SILENT for k in self.open[-2:]):
            return
        self.raw.append(text)
        self.n_raw += len(text)
        if text := text.strip():
            self.runs.append(text)

    def _close(self, depth: int) -> None:
        """Closes the open elements from a depth on."""
        for k in self.open[depth:]:
            self.elements[k] |= {"end": len(self.elements), "last": len(self.runs), "raw_last": self.n_raw}
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        self._flush()
        closes, border = _CLOSES.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.elements[self.open[depth]]["tag"]
            if name in border:
                break
            if name in closes:
                self._close(depth)
        self._open(tag, attrs)
        if tag in _VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.elements[self.open[depth]]["tag"] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self._flush()

    def tree(self, html: str) -> dict:
        self.feed(html)
        self.close()
        self._flush()
        self._close(0)
        if not any(e["tag"] == "body" for e in self.elements):  # the page is its own body, without its head and title
            top = {e["pos"] for e in self.elements if e["tag"] in ("#document", "html")}
            self.elements[0]["first"] = max([e["last"] for e in self.elements if e["tag"] in ("head", "title") and e["parent"] in top], default=0)
        return {"elements": self.elements, "runs": self.runs, "raw": "".join(self.raw)}


def page_trees(pages: DataFrame) -> DataFrame:
    """page_id, url, elements, runs (stripped texts between tags) and raw (all text as it is) of every page; a null page is an empty one."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("elements", pa.list_(_ELEMENT)), ("runs", pa.list_(pa.string())), ("raw", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
                yield pa.RecordBatch.from_pylist([{"page_id": page, "url": url} | _Tree().tree(html or "") for page, url, html in rows], schema=schema)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)


Test = Callable[[Column], Column]


def joined_in(e: Column, sep: str) -> Column:
    """All text of an element, its runs joined; null without an element."""
    return F.array_join(F.slice(F.col("runs"), e["first"] + 1, e["last"] - e["first"]), sep)


def text_in(e: Column) -> Column:
    return joined_in(e, " ")


def raw_in(e: Column) -> Column:
    return F.substring(F.col("raw"), e["raw_first"] + 1, e["raw_last"] - e["raw_first"])


def inside(e: Column) -> Column:
    """The elements within an element, in page order."""
    return F.slice(F.col("elements"), e["pos"] + 2, e["end"] - e["pos"] - 1)


def every(test: Test) -> Column:
    return F.filter(F.col("elements"), test)


def first_of(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def tagged(*tags: str) -> Test:
    return lambda e: e["tag"].isin(*tags)


def _whole(name: str) -> Test:
    return lambda e: F.array_contains(F.split(e["classes"], " "), name)


def _partly(part: str) -> Test:
    return lambda e: e["classes"].contains(part)


def class_part(e: Column, *parts: str) -> Column:
    return reduce(or_, [e["classes"].contains(p) for p in parts])


def attr(e: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(e["attrs"], F.lit(name)), F.lit(""))


# segments

_FOOTER, _HEADER = "(?i)footer|site-info|copyright", "(?i)header|top-bar|nav"


def _different(texts: Column) -> Column:
    """Texts joined by a space; one that the text so far holds already is left out."""
    return F.aggregate(texts, F.lit(""), lambda acc, t: F.when((t == "") | acc.contains(t), acc).when(acc == "", t).otherwise(F.concat(acc, F.lit(" "), t)))


def segments(trees: DataFrame) -> DataFrame:
    """main, header and footer text of every page.

    An element's text counts wherever it stands, so a header within an article is in both. main is all text of main
    elements, of role main, then of articles; without any, the body's text less the header and footer text.
    """

    def marked(tag: str, role: str, classes: str | None) -> Column:
        kinds = [every(tagged(tag)), every(lambda e: attr(e, "role") == role)] + ([every(lambda e: e["classes"].rlike(classes))] if classes else [])
        return F.concat(*kinds)

    texts = lambda xs: F.transform(xs, text_in)
    found = trees.select(
        "page_id", "runs", "elements", _different(texts(marked("footer", "contentinfo", _FOOTER))).alias("footer_text"), _different(texts(marked("header", "banner", _HEADER))).alias("header_text"),
        F.concat(marked("main", "main", None), every(tagged("article"))).alias("_mains"), first_of(every(tagged("body"))).alias("_body"),
    )
    rest = F.replace(F.replace(F.coalesce(text_in(F.col("_body")), F.lit("")), F.col("header_text")), F.col("footer_text"))
    main = F.array_join(F.filter(texts(F.col("_mains")), lambda t: t != ""), " ")
    return found.select("page_id", F.when(F.size("_mains") > 0, main).otherwise(rest).alias("main_text"), "header_text", "footer_text")


# product grids

_NAMES = ["h1", "h2", "h3", "h4", "h5", "strong"]
# fixed values: classes of cards, whole and in part, in the order in which they are tried
CARDS, CARD_PARTS, LEAST_CARDS, MOST_CARDS = ["product-card", "product-item", "item-card", "card"], ["product", "card", "item"], 3, 20
# fixed values: parts of classes of the elements that hold a page's text, in the order in which they are tried
CONTENT_CLASSES = [
    "content", "post-content", "article-body", "article", "entry", "post", "body-text", "post-body", "main-content", "page-content", "story-body", "article-text", "article-content", "text-content",
]
# fixed values: parts of classes and ids of elements that are not the longest
ASIDE = ["nav", "header", "footer", "menu", "sidebar", "widget", "ad"]


def with_cards(trees: DataFrame) -> DataFrame:
    """_cards: name and price of the product cards of a page, null if it has no grid.

    A card holds something like a title, a price or a button. The first kind of class with three such elements or more
    makes the grid.
    """
    name = lambda x: x["tag"].isin(*_NAMES) | class_part(x, "title", "name")
    priced = lambda x: class_part(x, "price") | (x["tag"] == "button") | ((x["tag"] == "a") & class_part(x, "shop", "buy"))
    some = every(lambda e: class_part(e, *CARD_PARTS) & F.exists(inside(e), lambda x: name(x) | priced(x)))
    kinds = [*map(_whole, CARDS), *map(_partly, CARD_PARTS)]
    grid = F.coalesce(*[F.when(F.size(F.filter("_some", k)) >= LEAST_CARDS, F.filter("_some", k)) for k in kinds])
    text = lambda e, test: F.coalesce(text_in(first_of(F.filter(inside(e), test))), F.lit(""))
    cards = F.transform(grid, lambda e: F.struct(text(e, name).alias("name"), text(e, lambda x: class_part(x, "price", "cost")).alias("price")))
    return trees.withColumn("_some", some).withColumn("_cards", cards).drop("_some")


def _card_text(card: Column) -> Column:
    return F.concat(card["name"], F.when(card["price"] != "", F.concat(F.lit(" ("), card["price"], F.lit(")"))).otherwise(""))


# containers of the text, shared by the plain and the structured body


def _content_divs() -> Column:
    """Divs by the kind of their class, then in page order."""
    of_kind = lambda p: every(lambda e: (e["tag"] == "div") & F.lower(e["classes"]).contains(p))
    return F.flatten(F.array(*map(of_kind, CONTENT_CLASSES)))


def _main() -> Column:
    return F.coalesce(first_of(every(tagged("main"))), first_of(every(lambda e: attr(e, "role") == "main")))


def _body() -> Column:
    return F.coalesce(first_of(every(tagged("body"))), first_of(F.col("elements")))


def _longest_div(sep: str = " \n ") -> Column:
    """The first of the divs with the longest text that is no navigation or the like, if it has 100 characters."""
    own = every(lambda e: (e["tag"] == "div") & ~reduce(or_, [F.concat(F.lower(e["classes"]), F.lit(" "), F.lower(attr(e, "id"))).contains(p) for p in ASIDE]))
    sized = F.transform(own, lambda e: F.struct(F.length(joined_in(e, sep)).alias("n"), (-e["pos"]).alias("at")))
    best = F.array_max(F.filter(sized, lambda s: s["n"] >= 100))
    return F.try_element_at(F.col("elements"), 1 - best["at"])


def body_text(trees: DataFrame, *keep: str) -> DataFrame:
    """page_id, url, step and body, and columns to keep: the text of the first step that gives enough.

    grid (100 characters), lists (150), tables (150), article (100), main (100), content (150), paragraphs (100), longest
    (100), else body. Lists have two items of over five characters, tables two rows. A page without anything has an
    empty body.
    """
    trees, sep = with_cards(trees), " \n "
    named = F.filter("_cards", lambda c: c["name"] != "")
    grid = F.array_join(F.transform(named, lambda c: F.concat(F.lit("- "), _card_text(c))), "\n")
    items = lambda u: F.filter(F.transform(F.filter(inside(u), lambda x: (x["parent"] == u["pos"]) & (x["tag"] == "li")), text_in), lambda t: F.length(t) > 5)
    lists = F.filter(F.transform(every(tagged("ul", "ol")), items), lambda xs: F.size(xs) >= 2)
    cells = lambda r: F.array_join(F.filter(F.transform(F.filter(inside(r), tagged("td", "th")), text_in), lambda t: t != ""), " | ")
    rows = lambda t: F.filter(F.transform(F.filter(inside(t), tagged("tr")), cells), lambda x: x != "")
    tables = F.filter(F.transform(every(tagged("table")), rows), lambda xs: F.size(xs) >= 2)
    whole = lambda e: joined_in(e, sep)
    steps: list[tuple[str, int, Column]] = [
        ("grid", 100, grid),
        ("lists", 150, F.array_join(F.transform(lists, lambda xs: F.array_join(F.transform(xs, lambda t: F.concat(F.lit("- "), t)), "\n")), "\n\n")),
        ("tables", 150, F.array_join(F.transform(tables, lambda xs: F.array_join(xs, "\n")), "\n\n")),
        ("article", 100, whole(first_of(every(tagged("article"))))),
        ("main", 100, whole(_main())),
        ("content", 150, whole(first_of(F.filter(_content_divs(), lambda e: F.length(whole(e)) >= 150)))),
        ("paragraphs", 100, F.array_join(F.filter(F.transform(every(tagged("p")), text_in), lambda t: t != ""), "\n\n")),
        ("longest", 100, whole(_longest_div())),
        ("body", 0, whole(_body())),
    ]
    out = trees.withColumn("_found", F.lit(None).cast("struct<step:string,body:string>"))
    for name, least, text in steps:  # a step is worked out only where those before gave too little
        out = out.withColumn("_found", F.when(F.col("_found").isNotNull(), F.col("_found")).otherwise(_if_enough(name, least, text)))
    return out.select("page_id", "url", *keep, "_found.step", "_found.body")


def page_bodies(trees: DataFrame, thin: int = 200) -> DataFrame:
    """body_text, or the page's OpenGraph description (step description) where the text has under 200 characters and there is one."""
    described = trees.withColumn("_description", attr(first_of(every(lambda e: (e["tag"] == "meta") & (attr(e, "property") == "og:description"))), "content"))
    text = F.btrim("_description", F.lit(" \t\r\n"))
    use = (F.length("body") < thin) & (F.col("_description") != "")
    found = body_text(described, "_description")
    return found.select("page_id", "url", F.when(use, "description").otherwise(F.col("step")).alias("step"), F.when(use, text).otherwise(F.col("body")).alias("body"))


def _if_enough(name: str, least: int, text: Column) -> Column:
    """step and body if the text is long enough, else null; the text is worked out once."""
    return first_of(F.transform(F.filter(F.array(text), lambda t: F.length(t) >= least), lambda t: F.struct(F.lit(name).alias("step"), t.alias("body"))))


# structured body


def semantic_role(tag: Column, classes: Column) -> Column:
    low = F.lower(classes)
    part = lambda words: low.rlike("|".join(words))
    return (
        F.when(tag.isin("h1", "h2"), "headline").when(tag.isin("h3", "h4"), "subheadline").when(tag.isin("h5", "h6"), "minor_heading")
        .when(part(["price", "product", "item", "card"]), "product_info").when(part(["hero", "banner", "jumbotron", "headline"]), "headline")
        .when(part(["subtext", "tagline", "subtitle", "subheading"]), "subheadline").when(part(["footer", "copyright", "legal"]), "footer_text").when(tag == "li", "list_item").otherwise("body_text")
    )


def _units(e: Column) -> Column:
    """Headings, paragraphs and list items of over five characters within an element; without any, its own divs of over ten."""
    as_unit = lambda x: F.struct(x["tag"].alias("tag"), semantic_role(x["tag"], x["classes"]).alias("role"), text_in(x).alias("text"))
    units = F.filter(F.transform(F.filter(inside(e), tagged("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")), as_unit), lambda u: F.length(u["text"]) > 5)
    divs = F.filter(F.transform(F.filter(inside(e), lambda x: (x["parent"] == e["pos"]) & (x["tag"] == "div")), as_unit), lambda u: F.length(u["text"]) > 10)
    return first_of(F.filter(F.array(units, divs), lambda xs: F.size(xs) > 0))


def _enough(units: Column, least: int) -> Column:
    return F.aggregate(units, F.lit(0), lambda n, u: n + F.length(u["text"])) >= least


def structured_body(trees: DataFrame) -> DataFrame:
    """page_id, pos, tag, role and text of the segments of a page's body, by the first step that gives some.

    At most 20 product cards with a name; the article, main element or a content div with enough text in its units (100,
    100, 150); all paragraphs (100); the longest div; the body. A page without any has no rows.
    """
    trees = with_cards(trees)
    one = lambda e: F.filter(F.array(e), lambda x: x.isNotNull())
    units_of = lambda es, least: first_of(F.filter(F.transform(es, _units), lambda us: us.isNotNull() & _enough(us, least)))
    cards = F.transform(F.filter(F.slice("_cards", 1, MOST_CARDS), lambda c: c["name"] != ""), lambda c: F.struct(F.lit("product_card").alias("tag"), F.lit("product_listing").alias("role"), _card_text(c).alias("text")))
    paragraphs = F.filter(F.transform(every(tagged("p")), lambda x: F.struct(x["tag"].alias("tag"), F.lit("body_text").alias("role"), text_in(x).alias("text"))), lambda u: u["text"] != "")
    steps = [
        first_of(F.filter(F.array(cards), lambda xs: F.size(xs) > 0)), units_of(one(first_of(every(tagged("article")))), 100), units_of(one(_main()), 100), units_of(_content_divs(), 150),
        first_of(F.filter(F.array(paragraphs), lambda xs: _enough(xs, 100))), units_of(one(_longest_div()), 0), units_of(one(_body()), 0),
    ]
    out = trees.withColumn("_found", F.lit(None).cast("array<struct<tag:string,role:string,text:string>>"))
    for step in steps:
        out = out.withColumn("_found", F.when(F.col("_found").isNotNull(), F.col("_found")).otherwise(step))
    # an inner explode would have its filter on _found pushed through every step, which doubles the plan each time
    return out.select("page_id", F.posexplode_outer("_found").alias("pos", "s")).where("s is not null").select("page_id", "pos", "s.tag", "s.role", "s.text")


# verification badges

# fixed values: fills, classes and colours of badges
_BLUE, _GOLD = ["rgb(0, 149, 246)", "0095f6"], ["#f4e72a", "#cd8105", "#cb7b00", "#e2b719"]
_CODED, _LEGACY = ["x1lliihq", "x1n2onr6", "x1q0g3np"], ["coreSpriteVerifiedBadge", "VerifiedBadge", "_acan"]
_PHRASES = ["verified email", "verified workplace", "identity verified", "workplace verified", "email verified"]


def _badge(kind: str | Column, evidence: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("badge_type"), evidence.alias("evidence"))


def _seen(test: Test, kind: str | Callable[[Column], Column], evidence: Callable[[Column], Column]) -> Column:
    """The badge that the first element with some trait shows."""
    return first_of(F.transform(every(test), lambda e: _badge(kind if isinstance(kind, str) else kind(e), evidence(e))))


def _ladders() -> dict[str, Column]:
    label, says = lambda e: attr(e, "aria-label"), lambda *parts: lambda e: F.concat(*[F.lit(p) if isinstance(p, str) else p(e) for p in parts])
    short, low = lambda e: F.substring(label(e), 1, 50), lambda e: F.lower(label(e))
    svg, exactly = tagged("svg"), lambda e, name: attr(e, name).rlike("(?i)^verified$")
    fill = lambda e: attr(e, "fill")
    blue = lambda e: fill(e).contains(_BLUE[0]) | F.lower(fill(e)).contains(_BLUE[1])
    title = lambda e: F.lower(F.trim(raw_in(first_of(F.filter(inside(e), tagged("title"))))))
    link = lambda e: F.coalesce(F.when(attr(e, "href") != "", attr(e, "href")), attr(e, "xlink:href"))
    coded = lambda c: _seen(lambda e: svg(e) & e["classes"].rlike(rf"\b{c}\b") & (blue(e) | (low(e) == "verified")), "blue_checkmark", says(f"Found SVG with 2024 class '{c}'"))
    legacy = lambda c: _seen(lambda e: F.lower(e["classes"]).contains(c.lower()), "blue_checkmark", says(f"Found element with legacy class '{c}'"))
    gold = lambda e: F.exists(F.slice(F.col("elements"), e["pos"] + 1, e["end"] - e["pos"]), lambda x: F.exists(F.map_values(x["attrs"]), lambda v: reduce(or_, [F.lower(v).contains(c) for c in _GOLD])))
    told = lambda e: F.exists(F.array(F.lower(raw_in(e))), lambda t: reduce(or_, [t.contains(p) for p in _PHRASES]))
    return {
        "instagram": F.coalesce(
            _seen(lambda e: svg(e) & (label(e) == "Verified") & blue(e), "blue_checkmark", says("Found Instagram verified SVG with fill=", fill)),
            _seen(lambda e: svg(e) & (title(e) == "verified"), "blue_checkmark", says("Found SVG with <title>Verified</title>")),
            _seen(lambda e: svg(e) & exactly(e, "aria-label"), "blue_checkmark", says("Found SVG with aria-label='Verified' (fill=", fill, ")")),
            *map(coded, _CODED),
            _seen(lambda e: exactly(e, "aria-label"), "blue_checkmark", says("Found element with aria-label='Verified': ", short)),
            *map(legacy, _LEGACY),
            _seen(lambda e: exactly(e, "title"), "blue_checkmark", says("Found element with title='Verified'")),
        ),
        "linkedin": F.coalesce(
            _seen(lambda e: (e["tag"] == "use") & F.lower(link(e)).contains("verified"), "verified_account", says("Found LinkedIn <use href='", link, "'>")),
            _seen(lambda e: svg(e) & (low(e).contains("verified") | low(e).contains("verification")), "verification_badge", says("Found SVG with verification aria-label: ", low)),
            _seen(lambda e: low(e).contains("verified") & ~low(e).contains("not"), lambda e: F.when(low(e).contains("account"), "verified_account").otherwise("verification_badge"), says("Found element with aria-label: ", short)),
            _seen(lambda e: e["tag"].isin("span", "div", "li-icon") & e["classes"].rlike("(?i)badge|verif|shield"), "verification_badge", says("Found verification badge element")),
            _seen(lambda e: e["tag"].isin("section", "div") & e["classes"].rlike("(?i)profile|about|contact") & told(e), "identity_verified", says("Found LinkedIn verification indicator in profile")),
        ),
        "twitter": F.coalesce(
            _seen(lambda e: attr(e, "data-testid") == "icon-verified", "gold_checkmark", says("Found element with data-testid='icon-verified'")),
            _seen(lambda e: F.lower(attr(e, "data-testid")).contains("verif"), "gold_checkmark", says("Found element with data-testid containing 'verified'")),
            _seen(lambda e: svg(e) & (label(e) == "Verified account"), "gold_checkmark", says("Found SVG with aria-label='Verified account'")),
            _seen(
                lambda e: low(e).contains("verified"), lambda e: F.when(low(e).contains("organization"), "verified_organization").when(low(e).contains("government"), "government_badge").otherwise("gold_checkmark"),
                says("Found element with aria-label: ", short),
            ),
            _seen(lambda e: svg(e) & F.exists(inside(e), lambda x: (x["tag"] == "lineargradient") & gold(x)), "gold_checkmark", says("Found SVG with gold gradient (X.com verified badge)")),
            _seen(lambda e: F.lower(e["classes"]).contains("verified"), "gold_checkmark", says("Found element with verification class: ", lambda e: F.substring(e["classes"], 1, 50))),
        ),
        "unknown": F.coalesce(
            _seen(lambda e: low(e).contains("verified"), "verification_badge", says("Found verification indicator via aria-label")),
            _seen(lambda e: exactly(e, "title"), "verification_badge", says("Found verification indicator via title")),
            _seen(lambda e: F.lower(e["classes"]).contains("verified"), "verification_badge", says("Found verification indicator via class")),
        ),
    }


def verification_badges(trees: DataFrame) -> DataFrame:
    """page_id, url, verified, platform, badge_type and evidence of every page; the url says which platform's signs are looked for, in order.

    Both texts are empty without a badge; a null url is of no known platform.
    """
    low = F.lower(F.coalesce("url", F.lit("")))
    platform = F.when(low.contains("instagram.com"), "instagram").when(low.contains("linkedin.com"), "linkedin").when(low.contains("twitter.com") | low.contains("x.com"), "twitter").otherwise("unknown")
    badge = reduce(lambda rest, kv: F.when(F.col("platform") == kv[0], kv[1]).otherwise(rest), list(_ladders().items()), F.lit(None).cast("struct<badge_type:string,evidence:string>"))
    found = trees.withColumn("platform", platform).withColumn("_badge", badge)
    text = lambda k: F.coalesce(F.col("_badge")[k], F.lit("")).alias(k)
    return found.select("page_id", "url", F.col("_badge").isNotNull().alias("verified"), "platform", text("badge_type"), text("evidence"))


def with_badges(content: DataFrame, badges: DataFrame) -> DataFrame:
    """Content rows whose meta says what badge their page shows: badge_verified, badge_platform, badge_type and badge_evidence, as far as it has no such keys yet.

    Of several pages with one url the smallest page_id counts; a null url has no page; repeated rows stay.
    """
    named = {"badge_verified": F.when(F.col("verified"), "true").otherwise("false"), "badge_platform": F.col("platform"), "badge_type": F.col("badge_type"), "badge_evidence": F.col("evidence")}
    entries = F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values()))
    one = badges.filter("url is not null").groupBy("url").agg(F.min_by(entries, "page_id").alias("_badge"))
    none = F.create_map().cast("map<string,string>")
    meta = F.map_zip_with(F.coalesce("meta", none), F.coalesce("_badge", none), lambda _, a, b: F.coalesce(a, b))
    return content.join(one.hint("shuffle_hash"), "url", "left").withColumn("meta", meta).drop("_badge")
