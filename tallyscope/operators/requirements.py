"""Holding a deck against what was asked of it: requirements with their scope and tone, and expected chart values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import text as X
from tallyscope.functions.scores import lit, severity_band
from tallyscope.sources.tables import written

#: The wording that forbids, that is critical, that names every page or one page, and that is no subject.
NEGATIVE = r"(?i)(?:不得|禁止|不可|不要|严禁|never|do\s+not|must\s+not)"
CRITICAL = r"(?i)(?:必须|务必|不得|禁止|不可|严禁|must|required|never|do\s+not)"
EVERY_PAGE = r"(?i)(?:每(?:一)?页|所有页|each\s+(?:page|slide)|every\s+(?:page|slide))"
PAGE_N = (r"第\s*(\d+)\s*页", r"(?i)(?:page|slide)\s*#?\s*(\d+)")
MODAL = r"(?i)\b(?:must|required|never|do\s+not|include|show|use)\b"
MODAL_HAN = r"必须|务必|不得|禁止|不可|不要|严禁|应当|需要|请|包含|展示|使用|加入|提供"
#: Satisfaction below which a critical requirement is a critical finding; and recall, for an expected value.
REQUIRED, EXPECTED = 0.45, 0.70
#: Charts of a deck with a token from which the token is a frequent one.
FREQUENT = 32
#: Charts of a deck, and characters of them together, up to which each expectation of the deck is held against all of them.
FEW, SHORT = 32, 16_384


def is_negative(text: Column) -> Column:
    return text.rlike(NEGATIVE)


def is_critical(text: Column) -> Column:
    return text.rlike(CRITICAL)


def named_pages(text: Column) -> Column:
    """The numbers of the pages that a requirement names, each once, in the order of the patterns."""
    numbers = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PAGE_N]
    return F.array_distinct(F.transform(F.concat(*numbers), lambda x: x.try_cast("long")))


def subject(text: Column) -> Column:
    """What a requirement is about: without its scope and modal words; the whole text if nothing is left."""
    left = text
    for pattern in (EVERY_PAGE, *PAGE_N, MODAL):
        left = F.regexp_replace(left, pattern, " ")
    left = F.regexp_replace(F.regexp_replace(left, MODAL_HAN, ""), r"^\s+|\s+$", "")
    return F.when(left != "", left).otherwise(text)


def worded(requirements: DataFrame) -> DataFrame:
    """`requirements` (text, declared, and others) with what their wording says, so that a wording that many decks are held
    against is read once: needed, needle, marks (the normalised tokens), negative, critical, every_page, named. Null and
    blank ones are left out."""
    text = F.col("text")
    rows = requirements.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumn("about", subject(text))
    rows = rows.withColumns({
        "needed": X.tokens(F.col("about")), "needle": X.normalize_text(F.col("about")), "negative": is_negative(text),
        "critical": F.coalesce("declared", F.lit(False)) | is_critical(text), "every_page": text.rlike(EVERY_PAGE), "named": named_pages(text),
    })
    return rows.withColumn("marks", F.filter(F.transform("needed", X.normalize_text), lambda t: t != "")).drop("text", "declared", "about")


def paged(objects: DataFrame) -> DataFrame:
    """deck, pages: the `objects` (deck, page, place, object, text) of each deck as an array of page, objects (place,
    object, text), both in order."""
    thing = F.struct("place", "object", "text")
    rows = objects.select("deck", F.col("page").cast("long").alias("page"), thing.alias("thing")).repartition("deck")
    own = rows.groupBy("deck", "page").agg(F.array_sort(F.collect_list("thing")).alias("objects"))
    return own.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("page", "objects"))).alias("pages"))


def read_pages(pages: Column) -> Column:
    """Pages (page, objects) as views: scope, items (page, object, norm), hay, tokens. Each object is normalised once and
    each page taken apart once, however many requirements the deck is held against."""
    text = lambda x: F.coalesce(x["text"], F.lit(""))
    item = lambda p: lambda x: F.struct(p["page"].alias("page"), x["object"].alias("object"), X.normalize_text(text(x)).alias("norm"))
    apart = lambda p: X.tokens(F.array_join(F.transform(p["objects"], text), "\n"))
    read = F.transform(pages, lambda p: F.struct(p["page"].alias("scope"), F.transform(p["objects"], item(p)).alias("items"), apart(p).alias("tokens")))
    hay = lambda v: F.array_join(F.transform(v["items"], lambda x: x["norm"]), "")
    return F.transform(read, lambda v: F.struct(v["scope"].alias("scope"), v["items"].alias("items"), hay(v).alias("hay"), v["tokens"].alias("tokens")))


def deck_view(views: Column) -> Column:
    """The view of a whole deck, with scope null, from the views of its pages."""
    of = lambda name: F.transform(views, lambda v: v[name])
    return F.struct(
        F.lit(None).cast("long").alias("scope"), F.flatten(of("items")).alias("items"), F.array_join(of("hay"), "").alias("hay"), F.array_distinct(F.flatten(of("tokens"))).alias("tokens"),
    )


def scoped(rows: DataFrame) -> DataFrame:
    """`rows` of worded requirements with the views and the whole view of their deck, once for each view of their scope:
    all pages if they name every page, the named pages that exist, else the whole deck. Each row carries the view of its
    scope alone, so the work on a deck grows with its length and not with its pages times it."""
    wanted = F.flatten(F.transform("named", lambda n: F.filter("views", lambda v: v["scope"].eqNullSafe(n))))
    own = F.when(F.col("every_page"), F.col("views")).otherwise(wanted)
    # objects without a page number are no page of their own: what would be held against them is held against the deck
    chosen = rows.withColumn("chosen", F.transform(own, lambda v: F.when(v["scope"].isNull(), F.col("whole")).otherwise(v)))
    view = F.explode(F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.array("whole")))
    return chosen.select("deck", "ord", "needed", "needle", "marks", "negative", "critical", view.alias("view"))


def observed(rows: DataFrame) -> DataFrame:
    """The observations of `rows`: worded requirements with the `views` (see `read_pages`) of their deck."""
    rows = scoped(rows)
    hits = lambda x: F.exists(F.col("marks"), lambda t: F.contains(x["norm"], t))
    found = F.get(F.filter("view.items", hits), F.lit(0))
    coverage = X.recall_of(F.col("needle"), F.col("needed"), F.col("view.hay"), F.col("view.tokens"))
    rows = rows.select("deck", "ord", F.col("view.scope").alias("scope"), coverage.alias("coverage"), "negative", "critical", found.alias("found"))
    met = F.when(F.col("negative"), lit(1) - F.col("coverage")).otherwise(F.col("coverage"))
    rows = rows.withColumn("satisfaction", met)
    severity = F.when(F.col("critical") & (F.col("satisfaction") < REQUIRED), "CRITICAL").otherwise(severity_band(F.col("satisfaction")))
    return rows.select(
        "deck", "ord", "scope", "coverage", "satisfaction", "negative", "critical", severity.alias("severity"), F.when(F.col("critical"), lit(1.5)).otherwise(lit(1)).alias("importance"),
        F.coalesce("found.page", "scope").alias("page"), F.col("found.object").alias("object"),
    )


def viewed(decks: DataFrame) -> DataFrame:
    """`decks` (pages, see `paged`, and others) with views and whole in place of pages."""
    return decks.withColumn("views", read_pages(F.col("pages"))).drop("pages").withColumn("whole", deck_view(F.col("views")))


def requirement_observations(requirements: DataFrame, objects: DataFrame) -> DataFrame:
    """deck, ord, scope, coverage, satisfaction, negative, critical, severity, importance, page, object: one row for each
    requirement and page of its scope.

    `requirements` (deck, ord, text, declared: said elsewhere to be critical), `objects` (deck, page, place, object, text)
    are what is visible. coverage is the recall of the requirement's subject in the text of its scope; for a forbidding
    one satisfaction is what is left of 1. page and object are the first, by page and place, that hold any token of the
    subject, within the scope; page falls back to the scope. Null and blank requirements are left out, and so are those of
    a deck without objects; null texts of objects count as empty. A deck's objects are one row, as a document is.
    """
    return observed(worded(requirements).join(viewed(paged(objects)), "deck"))


def _grams(norm: Column, size: int) -> Column:
    n = F.length(norm) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(norm, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _likely(asked: DataFrame, held: DataFrame) -> DataFrame:
    """deck, ord, critical, coverage, at, n_charts of the expectations of large decks (`asked`, with n_charts and the
    first place), whose charts are `held`.

    An expectation meets only charts that may be its best: those that share a rare token with it, those that hold its
    rarest run of three characters and so may hold it whole, for its frequent tokens the first of all charts with the
    same frequent ones (any other of these recalls no more and comes later), and the deck's first chart.
    """
    tokens = held.select("deck", "at", F.explode("held").alias("token"))
    counts = tokens.groupBy("deck", "token").agg(F.count(F.lit(1)).alias("n"))
    rare = tokens.join(counts.where(F.col("n") <= FREQUENT), ["deck", "token"])
    wanted = asked.select("deck", "ord", F.explode("needed").alias("token"))
    by_token = wanted.join(rare, ["deck", "token"]).select("deck", "ord", "at")
    often = tokens.join(counts.where(F.col("n") > FREQUENT), ["deck", "token"])
    marks = often.groupBy("deck", "at").agg(F.array_sort(F.collect_list("token")).alias("marks"))
    heads = marks.groupBy("deck", "marks").agg(F.min("at").alias("at"))
    by_mark = wanted.join(heads.select("deck", "at", F.explode("marks").alias("token")), ["deck", "token"]).select("deck", "ord", "at")
    pieces = held.select("deck", "at", F.explode(F.concat(*[_grams(F.col("hay"), q) for q in (1, 2, 3)])).alias("gram"))
    width = F.least(F.length("needle"), F.lit(3))
    own = F.when(F.col("width") == 1, _grams(F.col("needle"), 1)).when(F.col("width") == 2, _grams(F.col("needle"), 2)).otherwise(_grams(F.col("needle"), 3))
    needles = asked.withColumn("width", width).select("deck", "ord", F.explode(own).alias("gram"))
    sizes = pieces.groupBy("deck", "gram").agg(F.count(F.lit(1)).alias("n"))
    # a run that no chart has rules the whole needle out
    rarest = needles.join(sizes, ["deck", "gram"], "left").groupBy("deck", "ord").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    by_gram = rarest.where("x.n > 0").select("deck", "ord", F.col("x.gram").alias("gram")).join(pieces, ["deck", "gram"]).select("deck", "ord", "at")
    first = asked.select("deck", "ord", F.col("first").alias("at"))
    pairs = by_token.unionByName(by_mark).unionByName(by_gram).unionByName(first).distinct()
    weighed = pairs.join(asked.select("deck", "ord", "needed", "needle"), ["deck", "ord"]).join(held.select("deck", "at", "held", "hay"), ["deck", "at"])
    weighed = weighed.select("deck", "ord", "at", X.recall_of(F.col("needle"), F.col("needed"), F.col("hay"), F.col("held")).alias("coverage"))
    order = Window.partitionBy("deck", "ord").orderBy(F.col("coverage").desc(), F.col("at").asc())
    best = weighed.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    return asked.select("deck", "ord", "critical", "n_charts").join(best, ["deck", "ord"], "left").select("deck", "ord", "critical", "coverage", "at", "n_charts")


def best_charts(expectations: DataFrame, charts: DataFrame) -> DataFrame:
    """deck, ord, coverage, critical, severity, importance, page, object, n_charts: each expectation with the chart of its
    deck that recalls most of it, the first by page and place among equals.

    `expectations` (deck, ord, text, critical), `charts` (deck, page, place, object, text: its values). A deck of few and
    short charts is one row, and each of its expectations is held against all of them; for other decks see `_likely`.
    Without charts coverage is 0 and the place null. Null texts count as empty; an empty expectation is recalled by the
    first chart.
    """
    asked = expectations.withColumn("text", F.coalesce("text", F.lit("")))
    asked = asked.withColumns({"needed": X.tokens(F.col("text")), "needle": X.normalize_text(F.col("text"))})
    held = charts.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"held": X.tokens(F.col("text")), "hay": X.normalize_text(F.col("text"))})
    held = held.withColumn("at", F.struct(F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"), F.col("object").cast("string").alias("object")))
    # written once, as the size of a deck decides what its charts are held against
    held = written(held.select("deck", "at", "held", "hay"), "charts")
    decks = held.groupBy("deck").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n_charts"), F.sum(F.length("hay")).alias("chars"))
    small = (F.col("n_charts") <= FEW) & (F.col("chars") <= SHORT)
    shelves = held.join(decks.where(small).select("deck"), "deck", "left_semi").groupBy("deck").agg(F.collect_list(F.struct("at", "held", "hay")).alias("charts"))
    large = decks.where(~small)
    # the least is the best: coverage falls, places rise
    each = F.transform("charts", lambda c: F.struct((-X.recall_of(F.col("needle"), F.col("needed"), c["hay"], c["held"])).alias("less"), c["at"].alias("at")))
    rows = lambda best: ("deck", "ord", "critical", (-best["less"]).alias("coverage"), best["at"].alias("at"), "n_charts")
    shelved = lambda a: a.join(shelves, "deck", "left").withColumns({"best": F.array_min(each), "n_charts": F.array_size("charts").cast("long")}).select(*rows(F.col("best")))
    if large.isEmpty():
        found = shelved(asked)
    else:
        big = asked.join(large.select("deck", "n_charts", "first"), "deck")
        found = shelved(asked.join(large.select("deck"), "deck", "left_anti"))
        found = found.unionByName(_likely(big, held.join(large.select("deck"), "deck", "left_semi")))
    found = found.withColumns({"coverage": F.coalesce("coverage", lit(0)), "critical": F.coalesce("critical", F.lit(False))})
    severity = F.when(F.col("critical") & (F.col("coverage") < EXPECTED), "CRITICAL").otherwise(severity_band(F.col("coverage")))
    return found.select(
        "deck", "ord", "coverage", "critical", severity.alias("severity"), F.when(F.col("critical"), lit(1.5)).otherwise(lit(1)).alias("importance"),
        "at.page", "at.object", F.coalesce("n_charts", F.lit(0).cast("long")).alias("n_charts"),
    )
