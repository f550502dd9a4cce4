"""Queries of the element-tree operators, with their SQL twins: written-out pages by page_id, and the given pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.operators import detectors
from contentgauge.operators import page_tree as O
from contentgauge.sources.tables import table

#: Bodies by page_id % 10, each made for one step; {T} stands for a text of 6 to 220 characters that follows the id.
LAYOUTS = [
    '<div class="product-card"><h3>{T}</h3><span class="price">$1</span></div><div class="product-card big"><h3>Second one</h3><button>Buy</button></div><div class="product-card"><strong>Third</strong></div><div class="card">no name here</div><p>Tail text.</p>',
    "<ul><li>{T}</li><li>Another entry</li><li>abc</li></ul><ol><li>Only one entry here</li></ol><ul><li>{T}<li>x<ul><li>Nested entry one</li><li>Nested entry two</li></ul></ul>",
    "<table><tr><th>Name<th>Value</tr><tr><td>{T}</td><td> </td></tr><tr><td></td></tr></table><table><tr><td>Lone row</td></tr></table>",
    "<article><header><h1>Title</h1></header><p>{T}</p><script>var x = '<p>';</script></article><main>Main text {T}</main>",
    '<header>Top</header><div role="main" id="m">{T}<br>End of it</div><div class="site-info">Note</div><footer>Note</footer>',
    '<div class="Entry-Area">{T}</div><div class="post hero"><h2>{T}</h2><p class="subtext">And {T}</p></div>',
    "<p>{T}<p>Second <b>bold</b> &amp; one<p></p>",
    '<div class="sidebar">{T} {T}</div><div><span>{T}</span></div><div id="Menu">{T} {T} {T}</div>',
    '<div class="x"><h2>Heading here</h2><p>{T}</p></div><ul class="top-nav"><li>Home page</li></ul>',
    "<p> </p><!-- {T} -->",
]


def laid_out(spark, sf_dir):
    n = F.col("page_id")
    text = F.concat(F.lit("Page "), n.cast("string"), F.repeat(F.lit(" word"), (n % 41).cast("int")))
    html = F.element_at(F.array(*map(F.lit, LAYOUTS)), (n % len(LAYOUTS) + 1).cast("int"))
    page = F.concat(F.lit("<html><head><title>Of the head</title></head><body>"), F.replace(html, F.lit("{T}"), text), F.lit("</body></html>"))
    return table(spark, sf_dir, "pages").withColumn("html", page)


def b10_segments(spark, sf_dir):
    """Main, header and footer text of every given page."""
    return O.segments(O.page_trees(table(spark, sf_dir, "pages")))


def b10_layout_segments(spark, sf_dir):
    return O.segments(O.page_trees(laid_out(spark, sf_dir)))


def b16_structured_body(spark, sf_dir):
    return O.structured_body(O.page_trees(table(spark, sf_dir, "pages")))


def b16_layout_bodies(spark, sf_dir):
    return O.structured_body(O.page_trees(laid_out(spark, sf_dir)))


def b17_body_text(spark, sf_dir):
    """The step that gives every given page's text, and the text."""
    return O.body_text(O.page_trees(table(spark, sf_dir, "pages"))).drop("url")


def b17_layout_bodies(spark, sf_dir):
    return O.body_text(O.page_trees(laid_out(spark, sf_dir))).drop("url")


_IG, _IN, _X = "https://www.instagram.com/u", "https://www.linkedin.com/in/u", "https://x.com/u"
_IG_BLUE, _IN_MARK, _X_GOLD = "blue_checkmark", "verification_badge", "gold_checkmark"
#: Profile pages by page_id % 31: url, markup, badge_type and evidence (empty without a badge).
PROFILES = [
    (_IG, '<svg aria-label="Verified" class="x1lliihq" fill="rgb(0, 149, 246)" height="18"><title>Verified</title><path d="M1"></path></svg>', _IG_BLUE, "Found Instagram verified SVG with fill=rgb(0, 149, 246)"),
    (_IG, '<svg height="18" role="img"><title> Verified </title><path d="M1"/></svg>', _IG_BLUE, "Found SVG with <title>Verified</title>"),
    (_IG, '<svg aria-label="VERIFIED" fill="red"></svg>', _IG_BLUE, "Found SVG with aria-label='Verified' (fill=red)"),
    (_IG, '<svg class="a x1n2onr6" fill="#0095F6"><path/></svg>', _IG_BLUE, "Found SVG with 2024 class 'x1n2onr6'"),
    (_IG, '<span class="x1lliihq">followers</span><b aria-label="verified">v</b>', _IG_BLUE, "Found element with aria-label='Verified': verified"),
    (_IG, '<i class="p CORESPRITEVERIFIEDBADGE"></i>', _IG_BLUE, "Found element with legacy class 'coreSpriteVerifiedBadge'"),
    (_IG, '<i class="_acan" title="Verified"></i>', _IG_BLUE, "Found element with legacy class '_acan'"),
    (_IG, '<i title="verified"></i>', _IG_BLUE, "Found element with title='Verified'"),
    (_IG, '<header><h1>Some Profile</h1><span class="x1lliihq">followers</span></header>', "", ""),
    (_IG, '<svg aria-label="Verified" fill="#0095f6" height="18"><path/></svg>', _IG_BLUE, "Found Instagram verified SVG with fill=#0095f6"),
    (_IN, '<use href="#Verified-medium" width="24"></use>', "verified_account", "Found LinkedIn <use href='#Verified-medium'>"),
    (_IN, '<svg><use xlink:href="#verified-small"/></svg>', "verified_account", "Found LinkedIn <use href='#verified-small'>"),
    (_IN, '<svg aria-label="Verification mark"></svg>', _IN_MARK, "Found SVG with verification aria-label: verification mark"),
    (_IN, '<b aria-label="Not verified"></b><b aria-label="Verified account"></b>', "verified_account", "Found element with aria-label: Verified account"),
    (_IN, '<b aria-label="Is verified"></b>', _IN_MARK, "Found element with aria-label: Is verified"),
    (_IN, '<p class="badge"></p><li-icon class="Shield-icon"></li-icon>', _IN_MARK, "Found verification badge element"),
    (_IN, '<section class="Profile-card"><p>Has a Verified <b>email</b></p></section>', "identity_verified", "Found LinkedIn verification indicator in profile"),
    (_IN, '<section class="profile"><p>identity</p><p>verified</p></section><b aria-label="Not verified"></b>', "", ""),
    (_IN, '<section class="profile"><h1>John Doe</h1><span class="premium-member">Premium</span></section>', "", ""),
    (_X, '<svg viewBox="0 0 22 22" aria-label="Verified account" data-testid="icon-verified"><g></g></svg>', _X_GOLD, "Found element with data-testid='icon-verified'"),
    (_X, '<svg data-testid="UserVerifiedMark"></svg>', _X_GOLD, "Found element with data-testid containing 'verified'"),
    (_X, '<svg aria-label="Verified account" role="img"><path d="M1"></path></svg>', _X_GOLD, "Found SVG with aria-label='Verified account'"),
    (_X, '<b aria-label="Verified organization of the town, with a label that is long"></b>', "verified_organization", "Found element with aria-label: Verified organization of the town, with a label th"),
    (_X, '<b aria-label="verified government"></b>', "government_badge", "Found element with aria-label: verified government"),
    (_X, '<svg viewBox="0 0 22 22"><linearGradient id="g"><stop stop-color="#F4E72A"></stop></linearGradient></svg>', _X_GOLD, "Found SVG with gold gradient (X.com verified badge)"),
    (_X, '<i class="checkmark"></i><i class="is-Verified big"></i>', _X_GOLD, "Found element with verification class: is-Verified big"),
    (_X, '<div class="profile"><h1>Some User</h1><svg aria-label="Profile picture"></svg><stop stop-color="#f4e72a"></stop></div>', "", ""),
    ("https://www.tiktok.com/u", '<b aria-label="A verified one"></b>', _IN_MARK, "Found verification indicator via aria-label"),
    ("https://www.tiktok.com/u", '<b title="Verified"></b>', _IN_MARK, "Found verification indicator via title"),
    ("https://www.tiktok.com/u", '<b class="Unverified"></b>', _IN_MARK, "Found verification indicator via class"),
    ("https://www.tiktok.com/u", "<p>verified</p>", "", ""),
]


def profiles(spark, sf_dir):
    """Every given page with a profile's url and its mark in front of the article."""
    n = F.col("page_id")
    pick = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PROFILES]), (n % len(PROFILES) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(pick(0), n).alias("url"), F.replace("html", F.lit("<article>"), F.concat(pick(1), F.lit("<article>"))).alias("html"))


def b14_badges(spark, sf_dir):
    return O.verification_badges(O.page_trees(profiles(spark, sf_dir)))


def b14_accounts(spark, sf_dir):
    """What the account detector says of content whose pages' badges are in its meta."""
    pages = profiles(spark, sf_dir)
    own = F.when(F.col("page_id") % 4 == 0, F.create_map(F.lit("badge_verified"), F.lit("true")))
    content = pages.select("page_id", "url", F.lit("").alias("title"), F.lit("").alias("body"), F.lit("web").alias("src"), F.lit("text").alias("modality"), F.lit("web").alias("channel"), own.alias("meta"))
    found = detectors.detect_attributes(O.with_badges(content, O.verification_badges(O.page_trees(pages))), ["page_id"], ["verified_platform_account"], ("provenance",))
    return found.select("page_id", "value", "confidence")


QUERIES = {f.__name__: f for f in (b10_segments, b10_layout_segments, b14_accounts, b14_badges, b16_structured_body, b16_layout_bodies, b17_body_text, b17_layout_bodies)}

_T = "t AS (SELECT page_id, page_id % 10 AS k, 'Page ' || page_id || repeat(' word', page_id % 41) AS t FROM pages), n AS (SELECT *, length(t) AS n, ' ' || chr(10) || ' ' AS s, chr(10) AS nl FROM t)"


def _by_layout(*cases: str) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


def _of_profile(k: int) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "CASE page_id % 31 " + " ".join(f"WHEN {i} THEN {quoted(p[k])}" for i, p in enumerate(PROFILES)) + " END"


_GRID, _LISTS = "'- ' || t || ' ($1)' || nl || '- Second one' || nl || '- Third'", "'- ' || t || nl || '- Another entry' || nl || nl || '- ' || t || nl || '- x Nested entry one Nested entry two' || nl || nl || '- Nested entry one' || nl || '- Nested entry two'"
_TABLES, _PARAS, _POST = "'Name | Value' || nl || t", "t || nl || nl || 'Second bold & one'", "t || s || 'And ' || t"
#: By layout: the step and the text when there is enough, and otherwise.
_STEP = _by_layout(
    f"CASE WHEN length({_GRID}) >= 100 THEN 'grid' WHEN n + 5 >= 100 THEN 'longest' ELSE 'body' END", f"CASE WHEN length({_LISTS}) >= 150 THEN 'lists' ELSE 'body' END", f"CASE WHEN length({_TABLES}) >= 150 THEN 'tables' ELSE 'body' END",
    "CASE WHEN n + 8 >= 100 THEN 'article' WHEN n + 10 >= 100 THEN 'main' ELSE 'body' END", "CASE WHEN n + 12 >= 100 THEN 'main' ELSE 'body' END",
    "CASE WHEN n >= 150 OR 2 * n + 7 >= 150 THEN 'content' WHEN n + 4 >= 100 THEN 'paragraphs' WHEN 2 * n + 7 >= 100 THEN 'longest' ELSE 'body' END", "CASE WHEN n + 19 >= 100 THEN 'paragraphs' ELSE 'body' END",
    "CASE WHEN n >= 100 THEN 'longest' ELSE 'body' END", "CASE WHEN n >= 100 THEN 'paragraphs' WHEN n + 15 >= 100 THEN 'longest' ELSE 'body' END", "'body'",
)
_BODY = _by_layout(
    f"CASE WHEN length({_GRID}) >= 100 THEN {_GRID} WHEN n + 5 >= 100 THEN t || s || '$1' ELSE t || s || '$1' || s || 'Second one' || s || 'Buy' || s || 'Third' || s || 'no name here' || s || 'Tail text.' END",
    f"CASE WHEN length({_LISTS}) >= 150 THEN {_LISTS} ELSE t || s || 'Another entry' || s || 'abc' || s || 'Only one entry here' || s || t || s || 'x' || s || 'Nested entry one' || s || 'Nested entry two' END",
    f"CASE WHEN length({_TABLES}) >= 150 THEN {_TABLES} ELSE 'Name' || s || 'Value' || s || t || s || 'Lone row' END",
    "CASE WHEN n + 8 >= 100 THEN 'Title' || s || t WHEN n + 10 >= 100 THEN 'Main text ' || t ELSE 'Title' || s || t || s || 'Main text ' || t END",
    "CASE WHEN n + 12 >= 100 THEN t || s || 'End of it' ELSE 'Top' || s || t || s || 'End of it' || s || 'Note' || s || 'Note' END",
    f"CASE WHEN n >= 150 THEN t WHEN 2 * n + 7 >= 150 THEN {_POST} WHEN n + 4 >= 100 THEN 'And ' || t WHEN 2 * n + 7 >= 100 THEN {_POST} ELSE t || s || {_POST} END",
    f"CASE WHEN n + 19 >= 100 THEN {_PARAS} ELSE t || s || 'Second' || s || 'bold' || s || '& one' END", "CASE WHEN n >= 100 THEN t ELSE t || ' ' || t || s || t || s || t || ' ' || t || ' ' || t END",
    "CASE WHEN n >= 100 THEN t WHEN n + 15 >= 100 THEN 'Heading here' || s || t ELSE 'Heading here' || s || t || s || 'Home page' END", "''",
)
_MAIN = _by_layout(
    "t || ' $1 Second one Buy Third no name here Tail text.'", "t || ' Another entry abc Only one entry here ' || t || ' x Nested entry one Nested entry two'", "'Name Value ' || t || ' Lone row'", "'Main text ' || t || ' Title ' || t", "t || ' End of it'",
    "t || ' ' || t || ' And ' || t", "t || ' Second bold & one'", "t || ' ' || t || ' ' || t || ' ' || t || ' ' || t || ' ' || t", "'Heading here ' || t || ' '", "''",
)
_row = lambda tag, role, text: f"{{'tag': '{tag}', 'role': '{role}', 'text': {text}}}"
_li, _p = lambda text: _row("li", "list_item", text), lambda text: _row("p", "body_text", text)
_card = lambda text: _row("product_card", "product_listing", text)
_div = lambda text: f"list_filter([{_row('div', 'body_text', text)}], lambda x: length(x['text']) > 10)"
_NESTED = ", ".join(_li(f"'{x}'") for x in ("x Nested entry one Nested entry two", "Nested entry one", "Nested entry two"))
_UNITS = _by_layout(
    f"[{_card('''t || ' ($1)' ''')}, {_card(chr(39) + 'Second one' + chr(39))}, {_card(chr(39) + 'Third' + chr(39))}]",
    f"[{_li('t')}, {_li(chr(39) + 'Another entry' + chr(39))}, {_li(chr(39) + 'Only one entry here' + chr(39))}, {_li('t')}, {_NESTED}]", "NULL", f"[{_p('t')}]", _div("t || ' End of it'"),
    f"CASE WHEN 2 * n + 4 >= 150 OR n + 4 < 100 THEN [{_row('h2', 'headline', 't')}, {_row('p', 'subheadline', chr(39) + 'And ' + chr(39) + ' || t')}] ELSE [{_p(chr(39) + 'And ' + chr(39) + ' || t')}] END",
    f"[{_p('t')}, {_p(chr(39) + 'Second bold & one' + chr(39))}]", f"list_concat({_div(chr(116) + ' || chr(32) || t')}, {_div('t')}, {_div('t || chr(32) || t || chr(32) || t')})",
    f"CASE WHEN n >= 100 THEN [{_p('t')}] WHEN n + 15 >= 100 THEN [{_row('h2', 'headline', chr(39) + 'Heading here' + chr(39))}, {_p('t')}] ELSE [{_row('h2', 'headline', chr(39) + 'Heading here' + chr(39))}, {_p('t')}, {_li(chr(39) + 'Home page' + chr(39))}] END", "NULL",
)

_SPACE, _BREAK = "' '", "' ' || chr(10) || ' '"
_PLAIN = "regexp_replace(regexp_replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g')"


def _runs(x: str, sep: str) -> str:
    """The texts between the tags of a given page's part."""
    return f"array_to_string(list_filter(list_transform(string_split_regex({x}, '<[^>]*>'), lambda r: trim({_PLAIN.format(x='r')})), lambda r: r <> ''), {sep})"


_GIVEN = "g AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article, regexp_extract(html, '(?s)<footer>(.*)</footer>', 1) AS footer, regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '<!--.*?-->', '', 'g') AS body FROM pages)"
ORACLES = {
    "b10_segments": f"WITH {_GIVEN} SELECT page_id, {_runs('article', _SPACE)} AS main_text, '' AS header_text, {_runs('footer', _SPACE)} AS footer_text FROM g",
    # the navigation's list is too short, so the article is next, or all there is
    "b17_body_text": f"WITH {_GIVEN}, x AS (SELECT page_id, body, {_runs('article', _BREAK)} AS t FROM g) SELECT page_id, CASE WHEN length(t) >= 100 THEN 'article' ELSE 'body' END AS step, CASE WHEN length(t) >= 100 THEN t ELSE {_runs('body', _BREAK)} END AS body FROM x",
    # paragraphs end where they are closed or the next one begins; a short article leaves all paragraphs, short ones too, then the items of the navigation too, then divs
    "b16_structured_body": f"""WITH {_GIVEN}, h AS (SELECT page_id, list_transform(string_split_regex(article, '</?(?:p|h1)>'), lambda x, i: {{'tag': CASE WHEN i = 2 THEN 'h1' ELSE 'p' END, 'role': CASE WHEN i = 2 THEN 'headline' ELSE 'body_text' END, 'text': {_runs('x', _SPACE)}}}) AS own,
 list_transform(regexp_extract_all(body, '<li>(.*?)</li>', 1), lambda x: {{'tag': 'li', 'role': 'list_item', 'text': {_runs('x', _SPACE)}}}) AS items,
 list_transform(regexp_extract_all(body, '<div class="ad">(.*?)</div>', 1), lambda x: {{'tag': 'div', 'role': 'body_text', 'text': {_runs('x', _SPACE)}}}) AS divs FROM g),
k AS (SELECT page_id, list_filter(own, lambda x: length(x['text']) > 5) AS own, list_filter(own, lambda x: x['tag'] = 'p' AND x['text'] <> '') AS paras, list_filter(items, lambda x: length(x['text']) > 5) AS items, list_filter(divs, lambda x: length(x['text']) > 10) AS divs FROM h),
u AS (SELECT page_id, CASE WHEN list_sum(list_transform(own, lambda x: length(x['text']))) >= 100 THEN own WHEN list_sum(list_transform(paras, lambda x: length(x['text']))) >= 100 THEN paras WHEN len(items) + len(own) > 0 THEN list_concat(items, own) ELSE divs END AS us FROM k)
SELECT page_id, CAST(k - 1 AS INTEGER) AS pos, us[k]['tag'] AS tag, us[k]['role'] AS role, us[k]['text'] AS text FROM u, generate_series(1, len(us)) AS s(k)""",
    "b10_layout_segments": f"WITH {_T} SELECT page_id, {_MAIN} AS main_text, CASE k WHEN 3 THEN 'Title' WHEN 4 THEN 'Top' WHEN 8 THEN 'Home page' ELSE '' END AS header_text, CASE k WHEN 4 THEN 'Note' ELSE '' END AS footer_text FROM n",
    "b17_layout_bodies": f"WITH {_T} SELECT page_id, {_STEP} AS step, {_BODY} AS body FROM n",
    "b16_layout_bodies": f"WITH {_T}, u AS (SELECT page_id, {_UNITS} AS us FROM n), x AS (SELECT page_id, CAST(generate_subscripts(us, 1) - 1 AS INTEGER) AS pos, unnest(us) AS x FROM u) SELECT page_id, pos, x['tag'] AS tag, x['role'] AS role, x['text'] AS text FROM x",
    "b14_badges": f"""WITH b AS (SELECT page_id, {_of_profile(0)} || page_id AS url, {_of_profile(2)} AS badge_type, {_of_profile(3)} AS evidence FROM pages)
SELECT page_id, url, badge_type <> '' AS verified, CASE WHEN page_id % 31 < 10 THEN 'instagram' WHEN page_id % 31 < 19 THEN 'linkedin' WHEN page_id % 31 < 27 THEN 'twitter' ELSE 'unknown' END AS platform, badge_type, evidence FROM b""",
    # an account without a badge counts as one of a social host
    "b14_accounts": f"SELECT page_id, CASE WHEN page_id % 4 = 0 OR {_of_profile(2)} <> '' THEN 10e0 ELSE 3e0 END AS value, CASE WHEN page_id % 4 = 0 OR {_of_profile(2)} <> '' THEN 1e0 ELSE 0.7e0 END AS confidence FROM pages",
}
