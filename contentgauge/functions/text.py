"""Text expressions: cleaning, fingerprints, gates, language and triage rules as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: entities in the order in which they are decoded
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]

# fixed values: titles and phrases of error pages and login walls
ERROR_TITLES = ["access denied", "error", "404", "403", "401", "500", "not found", "page not found", "forbidden", "unauthorized", "server error", "bad request", "service unavailable"]
ERROR_TITLE_PARTS = ["error", "404", "403", "401", "500", "denied", "forbidden"]
ERROR_BODY_PARTS = ["access denied", "error occurred"]
LOGIN_TITLES = ["login", "sign in", "sign up", "register", "authentication required", "please log in"]
LOGIN_TITLE_PARTS = ["login", "sign in", "sign up", "register", "auth"]
LOGIN_BODY_PARTS = [
    "email or mobile number", "username and password", "sign in to continue", "login to access", "please log in", "authentication required",
    "otp code", "captcha", "send otp", "create account", "forgot password",
]
FUNCTIONAL_TITLE_PARTS = ["login", "sign in", "sign up", "register", "cart", "checkout", "forgot password"]
TRIAGE_ERROR_PARTS = ["404", "page not found", "internal server error", "access denied"]

# fixed values: indicators of a language, looked for in lower-cased text
FRENCH = [
    "à", "é", "è", "ê", "ç", "œ", " le ", " la ", " les ", " de ", " du ", " des ", " un ", " une ", " et ", " ou ", " pour ", " avec ", " dans ",
    " sur ", " par ", "ceci", "cela", "est", "sont", "bonjour", "tout", "français", "québec", "montréal",
]
SPANISH = [
    "ñ", "á", "é", "í", "ó", "ú", "¿", "¡", " el ", " la ", " los ", " las ", " de ", " del ", " un ", " una ", " y ", " o ", " para ", " con ",
    " en ", " por ", "esto", "eso", "es", "son", "hola", "todo", "español", "méxico",
]
ENGLISH = [
    " the ", " and ", " of ", " to ", " in ", " is ", " you ", " that ", " it ", " he ", " was ", " for ", " on ", " are ", " as ", " with ",
    " his ", " they ", " at ", " be ", " this ", " have ", " from ", " or ", " one ", " had ", " by ",
]

MIN_BODY, SPACE = 100, r"(?U)\s+"


# fixed values: names of languages by code
LANGUAGES = {
    "en": "English", "fr": "French", "es": "Spanish", "de": "German", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "ru": "Russian", "ja": "Japanese", "zh": "Chinese", "ko": "Korean",
    "ar": "Arabic", "unknown": "Unknown",
}


def language_name(code: Column) -> Column:
    """The name of a language, or the code in capitals."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), F.upper(code))


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed; a single space, which most runs are, is left where it is."""
    return F.trim(F.regexp_replace(text, r"(?U)(?: \s|[\s&&[^ ]])\s*", " "))


def clean_text(text: Column) -> Column:
    """White space squeezed, six entities decoded in order, urls removed, repeated marks squeezed, trimmed."""
    out = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, squeeze(F.coalesce(text, F.lit(""))))
    out = F.regexp_replace(out, r"https?://[!$-_a-z]+", "")
    for mark, least, to in (("!", 2, "!"), ("?", 2, "?"), (".", 3, "...")):
        out = F.regexp_replace(out, f"[{mark}]{{{least},}}", to)
    return F.trim(out)


def fingerprint(title: Column, body: Column) -> Column:
    """MD5 of the joined MD5s of the first 50 words of the lower-cased title and body; the text behind them is not split."""
    words = F.filter(F.split(F.lower(F.concat(title, F.lit(" "), body)), SPACE, 52), lambda w: w != "")  # at most one is empty, and the last is the rest
    return F.md5(F.array_join(F.transform(F.slice(words, 1, 50), F.md5), ""))


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def has_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def count_of(text: Column, parts: list[str]) -> Column:
    return reduce(add, [text.contains(p).cast("int") for p in parts])


def skip_reason(title: Column, body: Column) -> Column:
    """error_page before login_wall before insufficient_content; null for content to score.

    No character lower-cases to less than one, so the first thousand of the lower-cased body come from its own first thousand.
    """
    start = bound(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 1000)), lambda low: F.struct(F.substring(low, 1, 500).alias("few"), F.substring(low, 1, 1000).alias("more")))
    texts = F.struct(F.lower(F.trim(F.coalesce(title, F.lit("")))).alias("title"), start.alias("low"), F.length(F.coalesce(body, F.lit(""))).alias("n"))
    error = lambda x: x["title"].isin(ERROR_TITLES) | has_any(x["title"], ERROR_TITLE_PARTS) | has_any(x["low"]["few"], ERROR_BODY_PARTS)
    login = lambda x: x["title"].isin(LOGIN_TITLES) | has_any(x["title"], LOGIN_TITLE_PARTS) | has_any(x["low"]["more"], LOGIN_BODY_PARTS)
    return bound(texts, lambda x: F.when(error(x), "error_page").when(login(x), "login_wall").when(x["n"] < MIN_BODY, "insufficient_content"))


def language(text: Column) -> Column:
    """unknown below ten characters; French or Spanish by more than three indicators, and more than English has; else English."""
    counts = lambda low: F.struct(F.length(F.trim(low)).alias("n"), *[count_of(low, x).alias(c) for c, x in (("fr", FRENCH), ("es", SPANISH), ("en", ENGLISH))])
    return bound(
        bound(F.lower(F.coalesce(text, F.lit(""))), counts),
        lambda c: F.when(c["n"] < 10, "unknown").when((c["fr"] > 3) & (c["fr"] > c["en"]), "fr").when((c["es"] > 3) & (c["es"] > c["en"]), "es").otherwise("en"),
    )


def triage(title: Column, body: Column) -> Column:
    """Whether to score (to_score), why not (reason) and the score to take then (default_score)."""
    title, size = F.lower(F.coalesce(title, F.lit(""))), F.length(F.trim(F.coalesce(body, F.lit(""))))
    reason = (
        F.when(size < MIN_BODY, "too_short")
        .when(has_any(title, FUNCTIONAL_TITLE_PARTS) & (size < 300), "functional_page")
        .when(has_any(title, TRIAGE_ERROR_PARTS), "error_page")
    )
    return F.struct(reason.isNull().alias("to_score"), F.coalesce(reason, F.lit("passed")).alias("reason"), F.when(reason.isNull(), 0.0).otherwise(0.5).alias("default_score"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != ""))


def triage_score(title: Column, body: Column, keywords: list[str]) -> Column:
    """0.5, 0.2 more with a keyword, 0.1 less below 30 words, 0.1 more above 80; in [0, 1]."""
    low = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    n = word_count(body)
    known = F.when(has_any(low, [k.lower() for k in keywords]), 0.2).otherwise(0.0) if keywords else F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + known + F.when(n < 30, -0.1).when(n > 80, 0.1).otherwise(0.0)))


def normalize_rating(rating: Column, source: Column) -> Column:
    return F.when(source == "amazon", (rating - 1) / 4).when(source == "reddit", rating).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), rating)))


def truncate(text: Column, most: int = 10_000) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


# fixed values: what summaries leave out of a text
UI_PHRASES = ["Learn more", "Read more", "Close", "Cookie settings", "Subscribe", "Sign in", "Log in", "What can I help with", "Show more"]


def shortened(text: Column, most: int) -> Column:
    """At most that many characters, up to a full stop in the second half or else to a word's end, and an ellipsis."""
    t = F.trim(text)
    cut = F.substring(t, 1, most)
    stop = F.length(cut) - F.length(F.substring_index(cut, ".", -1))  # the place of the last full stop, from 1
    words = F.regexp_replace(F.regexp_replace(cut, " [^ ]*$", ""), "[.,;:]+$", "")
    return F.when(F.length(t) <= most, t).when(stop - 1 > most // 2, F.concat(F.trim(F.substring(cut, F.lit(1), stop)), F.lit("…"))).otherwise(F.concat(words, F.lit("…")))


def without_interface(body: Column) -> Column:
    """Text in single spaces without phrases of an interface and runs of short words."""
    clean = F.trim(F.regexp_replace(body, r"(?U)\s+", " "))
    for p in UI_PHRASES:
        clean = F.replace(clean, F.lit(p), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(clean, r"(?:(?U:\b)[A-Za-z]{1,3}(?U:\b\s*)){1,4}", ""), "[-_=]{2,}", " "))
