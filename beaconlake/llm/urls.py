"""URL filtering by rules and a character language-model ratio, in DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm.base import materialize, table

#: (host, start of the path, verdict); the longest rule that fits decides.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDER, STRENGTH, LEAST_CONTEXT, SYMBOLS = 3, 4.0, 8, 33


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _by_rule(rules, value) -> Column:
    """value(rule) of the longest rule that fits host and path; null if none does."""
    found = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.lit(value(host, path, verdict))).otherwise(found)
    return found


def _shape(host: Column, path: Column) -> Column:
    """The text that the models see: letters, one digit, . - / _ and one sign for all else, between
    start signs and an end sign. 33 signs can follow 34 in three places: 1.3 million grams at most."""
    low = F.translate(F.concat(host, path), string.ascii_uppercase, string.ascii_lowercase)
    plain = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9./_-]", "~"), "[0-9]", "0")
    return F.concat(F.lit("^" * ORDER), plain, F.lit("$"))


def _grams(shape: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(shape) - ORDER), lambda i: shape.substr(i, F.lit(ORDER + 1)))


def _log_ratio(grams: DataFrame) -> DataFrame:
    """(gram, accepted, rejected) -> (gram, micro): millionths of ln p(last | before) accepted to rejected.

    Each order's estimate is its count smoothed towards the next shorter context's; a context seen
    fewer than LEAST_CONTEXT times adds nothing, so the order varies with what was seen.
    """
    g = grams
    for side in ("accepted", "rejected"):
        p = (F.sum(side).over(Window.partitionBy(F.substring("gram", ORDER + 1, 1))) + F.lit(STRENGTH / SYMBOLS)) / (F.sum(side).over(Window.partitionBy()) + F.lit(STRENGTH))
        g = g.withColumn(f"p_{side}", p)
        for k in range(1, ORDER + 1):
            seen = F.sum(side).over(Window.partitionBy(F.substring("gram", ORDER + 1 - k, k + 1)))
            context = F.sum(side).over(Window.partitionBy(F.substring("gram", ORDER + 1 - k, k)))
            g = g.withColumn("seen", seen).withColumn("context", context).withColumn(
                f"p_{side}", F.when(F.col("context") < LEAST_CONTEXT, F.col(f"p_{side}"))
                .otherwise((F.col("seen") + F.lit(STRENGTH) * F.col(f"p_{side}")) / (F.col("context") + F.lit(STRENGTH))))
    return g.select("gram", F.round((F.log("p_accepted") - F.log("p_rejected")) * 1e6).cast("long").alias("micro"))


def _score(urls: DataFrame, ratios: DataFrame, keep: list[str]) -> DataFrame:
    """Adds score, thousandths of a nat for each character. The model is broadcast: its size is bounded
    by the alphabet. A URL's grams meet again in partial sums before anything is shuffled."""
    rows = urls.withColumn("row_", F.monotonically_increasing_id())
    grams = rows.select("row_", *keep, F.explode(_grams(F.col("shape"))).alias("gram"))
    return (grams.join(F.broadcast(ratios), "gram").groupBy("row_", *keep)
            .agg(F.sum("micro").alias("sum_"), F.count("*").alias("n_"))
            .select(*keep, F.floor(F.col("sum_") / (F.col("n_") * 1000)).alias("score")))


def _threshold(scored: DataFrame) -> int:
    """The score that splits accepted from rejected with the least sum of both error rates: half way between
    the lowest score on its upper side and the next one below."""
    bins = scored.groupBy("score").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    up = Window.orderBy("score")
    cost = bins.select(
        "score", F.coalesce(F.lag("score").over(up), F.col("score")).alias("below"),
        (F.coalesce(F.sum("a").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.sum("r").over(Window.partitionBy())
         + F.sum("r").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)) * F.sum("a").over(Window.partitionBy())).alias("cost"))
    least = cost.agg(F.min(F.struct("cost", "score", "below")).alias("x")).select(F.ceil((F.col("x.score") + F.col("x.below")) / 2)).first()
    return 0 if least is None or least[0] is None else least[0]


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every URL.

    A rule's host fits itself and all subdomains if the path starts with the rule's; the longest one
    gives the verdict. URLs that rules decide train two character models, of accepted and of rejected
    URLs; the others are allowed if their log-likelihood difference for each character reaches a
    threshold calibrated on three sixteenths of the decided URLs, by hash, which the models don't see.

    A null URL, or one without ://, has empty host and path and is judged by the models (on its end
    sign alone). Ids may be null or repeat; every row is judged by itself. Very long URLs are scored
    whole. Other columns are ignored. With no decided URL the models are equal, the threshold is 0
    and all are allowed. An empty table gives an empty result.
    """
    url = F.col("url")
    judged = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
              .select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
              .withColumns({
                  "rule": _by_rule(rules, lambda h, p, v: h + p), "verdict": _by_rule(rules, lambda h, p, v: v),
                  "shape": _shape(F.col("host"), F.col("path")),
                  "tuning": F.substring(F.md5("url"), 1, 1).isin("0", "1", "2")}))
    learnt = lambda v: F.count_if((F.col("verdict") == v) & ~F.col("tuning"))
    counted = (judged.select("verdict", "tuning", F.explode(_grams(F.col("shape"))).alias("gram"))
               .groupBy("gram").agg(learnt("allow").alias("accepted"), learnt("block").alias("rejected")))
    ratios = materialize(_log_ratio(counted), "url-model")
    at = _threshold(_score(judged.where("verdict IS NOT NULL AND tuning").select("verdict", "shape"), ratios, ["verdict"]))
    open_ = _score(judged.where("verdict IS NULL"), ratios, ["page_id", "host", "path"])
    by_model = open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.when(F.col("score") >= at, "allow").otherwise("block").alias("verdict"), F.col("score").cast("long"))
    by_rule = judged.where("verdict IS NOT NULL").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("long").alias("score"))
    return by_rule.unionByName(by_model)


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql_sides() -> str:
    """One step of the smoothing for each order, from the letter itself to the longest context."""
    steps, last = [], "p0"
    steps.append("p0 AS (SELECT *, " + ", ".join(
        f"(sum({s}) OVER (PARTITION BY substr(gram, 4, 1)) + {STRENGTH / SYMBOLS!r}::DOUBLE) / (sum({s}) OVER () + {STRENGTH}::DOUBLE) AS {s[0]}0" for s in ("accepted", "rejected")) + " FROM counted)")
    for k in range(1, ORDER + 1):
        cols = ", ".join(
            f"CASE WHEN sum({s}) OVER (PARTITION BY substr(gram, {4 - k}, {k})) < {LEAST_CONTEXT} THEN {s[0]}{k - 1} "
            f"ELSE (sum({s}) OVER (PARTITION BY substr(gram, {4 - k}, {k + 1})) + {STRENGTH}::DOUBLE * {s[0]}{k - 1}) / (sum({s}) OVER (PARTITION BY substr(gram, {4 - k}, {k})) + {STRENGTH}::DOUBLE) END AS {s[0]}{k}"
            for s in ("accepted", "rejected"))
        steps.append(f"p{k} AS (SELECT *, {cols} FROM {last})")
        last = f"p{k}"
    return ",\n".join(steps)


#: The contract's rules, longest first, written out here once more: the SQL shares nothing with RULES.
_SQL_FIRST_RULE = """CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END"""
_SQL_VERDICT = "CASE rule WHEN 'example.org/en/1' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'com/fr/' THEN 'allow' WHEN 'com/de/' THEN 'block' WHEN 'org/' THEN 'allow' END"

OP5_SQL = f"""
WITH parts AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT *, {_SQL_FIRST_RULE} AS rule FROM hp),
judged AS (SELECT *, {_SQL_VERDICT} AS verdict,
  '^^^' || regexp_replace(regexp_replace(translate(host || path, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^a-z0-9./_-]', '~', 'g'), '[0-9]', '0', 'g') || '$' AS shape,
  substr(md5(url), 1, 1) IN ('0', '1', '2') AS tuning, row_number() OVER () AS row_ FROM ruled),
grams AS (SELECT row_, verdict, tuning, substr(shape, i, 4) AS gram FROM (SELECT *, unnest(range(1, length(shape) - 2)) AS i FROM judged)),
counted AS (SELECT gram, count(*) FILTER (WHERE verdict = 'allow' AND NOT tuning) AS accepted, count(*) FILTER (WHERE verdict = 'block' AND NOT tuning) AS rejected FROM grams GROUP BY gram),
{_sql_sides()},
ratios AS (SELECT gram, round((ln(a3) - ln(r3)) * 1000000::DOUBLE)::BIGINT AS micro FROM p3),
scored AS (SELECT row_, floor(sum(micro)::DOUBLE / (count(*) * 1000))::BIGINT AS score FROM grams JOIN ratios USING (gram) GROUP BY row_),
bins AS (SELECT score, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS r
         FROM scored JOIN judged USING (row_) WHERE verdict IS NOT NULL AND tuning GROUP BY score),
cost AS (SELECT score, coalesce(lag(score) OVER (ORDER BY score), score) AS below, coalesce(sum(a) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(r) OVER ()
         + sum(r) OVER (ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * sum(a) OVER () AS cost FROM bins),
cut AS (SELECT coalesce((SELECT ceil((score + below) / 2.0)::BIGINT FROM cost ORDER BY cost, score LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= (SELECT t FROM cut) THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN verdict IS NULL THEN score END AS score
FROM judged JOIN scored USING (row_)
"""
