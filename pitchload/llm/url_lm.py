"""URL filter: rules, and a ratio of character language models for the rest.

Rules are a host and the beginning of a path; a rule fits its host and all subdomains, the longest that
fits decides. URLs that a rule decides train two variable-order Markov models over the characters of
host and path, one of the accepted and one of the rejected. An order's estimate is smoothed into the
next lower one by Witten-Bell: P(c | s) = (n(s c) + t(s) P(c | s')) / (n(s) + t(s)), where t(s) is the
number of different characters seen behind s and s' lacks the first character; a context that was never
seen leaves the lower order's estimate as it is. A URL's score is the mean log-ratio of its characters.

Half of the ruled URLs (by a hash of the text) trains, the other half calibrates: the threshold is the
score step that best separates accepted from rejected ones, half way to the next lower one seen. All counts are over all pages. Only
DataFrame functions are used. Log-ratios are whole millionths, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the rules of the registered query (verdict, host and path's beginning)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
ORDER = 3                 # characters of context at most
ALPHABET = 256            # the lowest order's estimate is 1 / ALPHABET
STEP = 10_000             # millionths of a nat: width of a threshold step
SALT = 16                 # parts that a character run's occurrences are dealt to
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path; both empty for a null or a URL without `://`."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (of equals the first in text order) and its verdict; else null."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]), reverse=True):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        which, verdict = F.when(fits, r).otherwise(which), F.when(fits, said).otherwise(verdict)
    return which, verdict


def _runs(texts: DataFrame, *keep: str) -> DataFrame:
    """Every character of column `s` with up to ORDER characters before it, as column `run`."""
    run = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substring(
        F.col("s"), F.greatest(F.lit(1), i - ORDER), F.least(F.lit(ORDER + 1), i)))
    return texts.select(*keep, F.explode(run).alias("run"))


def _ratios(runs: DataFrame, train: DataFrame) -> DataFrame:
    """(run, ratio): log-ratio, in millionths, of the last character of every run given those before it.

    `train` is (run, a, b): occurrences among accepted and rejected URLs.
    """
    grams = train.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length("run")), lambda k: F.substring(F.col("run"), F.length("run") - k + 1, k))).alias("gram"), "a", "b")
    grams = grams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    context = grams.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(
        F.sum("a").alias("na"), F.sum((F.col("a") > 0).cast("long")).alias("ta"),
        F.sum("b").alias("nb"), F.sum((F.col("b") > 0).cast("long")).alias("tb"))
    model = grams.select("gram", "a", "b").alias("g")
    out = runs.select("run").distinct().select("run", F.lit(1 / ALPHABET).alias("pa"), F.lit(1 / ALPHABET).alias("pb"))
    for k in range(ORDER + 1):
        has = F.length("run") > k
        out = (out.withColumn("gram", F.when(has, F.expr(f"right(run, {k + 1})")))
               .withColumn("context", F.when(has, F.expr(f"left(right(run, {k + 1}), {k})")))
               .join(model, "gram", "left").join(context, "context", "left"))

        def mixed(p, n, total, kinds):
            seen = F.coalesce(F.col(total), F.lit(0)) + F.coalesce(F.col(kinds), F.lit(0))
            return F.when(seen > 0, (F.coalesce(F.col(n), F.lit(0)) + F.col(kinds) * F.col(p)) / seen).otherwise(F.col(p))
        out = out.select("run", mixed("pa", "a", "na", "ta").alias("pa"), mixed("pb", "b", "nb", "tb").alias("pb"))
    return out.select("run", F.round((F.log("pa") - F.log("pb")) * 1e6).cast("long").alias("ratio"))


def _scored(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(s, step): the score step of every distinct s; hot runs are dealt to SALT parts."""
    runs = _runs(texts.select("s"), "s").withColumn("part", F.pmod(F.xxhash64("s"), F.lit(SALT)))
    dealt = ratios.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    total = runs.join(dealt, ["run", "part"]).groupBy("s").agg(F.sum("ratio").alias("total"))
    return total.select("s", F.floor(F.col("total") / F.length("s") / STEP).alias("step"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages` (page_id, url; others are ignored).

    A URL that no rule decides is allowed if its score reaches the threshold. One without host and path
    (null, empty or without `://`) is allowed. If either model has no URLs to calibrate with, the
    threshold is 0. Repeated rows count as often as they occur and get equal verdicts; an empty table
    gives an empty table.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    which, said = rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", which).withColumn("said", said).withColumn("s", F.concat("host", "path"))
    texts = rows.where("s <> ''").groupBy("s", "said").agg(F.count(F.lit(1)).alias("n"))
    texts = texts.withColumn("half", F.when(F.substring(F.md5("s"), 1, 1) < "8", 0).otherwise(1))

    train = (_runs(texts.where("said is not null and half = 0"), "said", "n").groupBy("run").agg(
        F.sum(F.when(F.col("said") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("said") == "block", F.col("n")).otherwise(0)).alias("b")))
    asked = texts.where("said is null or half = 1")
    steps = _scored(asked, _ratios(_runs(asked), train)).join(texts, "s")

    bins = steps.where("said is not null").groupBy("step").agg(
        F.sum(F.when(F.col("said") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("said") == "block", F.col("n")).otherwise(0)).alias("b"))
    above, all_ = Window.orderBy(F.desc("step")), Window.partitionBy()       # a few thousand steps at most
    lower = F.lead("step").over(above)          # the threshold lies half way to the next lower step that occurs
    best = (bins.withColumn("least", F.coalesce(F.floor((F.col("step") + lower) / 2) + 1, F.col("step")))
            .withColumn("ca", F.sum("a").over(above)).withColumn("cb", F.sum("b").over(above))
            .withColumn("ta", F.sum("a").over(all_)).withColumn("tb", F.sum("b").over(all_)).where("ta > 0 and tb > 0")
            .withColumn("gain", F.round(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"), 9))
            .agg(F.max(F.struct(F.col("gain"), (-F.abs("step")).alias("near"), F.col("step"), F.col("least"))).alias("best"))
            .select(F.coalesce("best.least", F.lit(0)).alias("least")))
    verdicts = steps.where("said is null").crossJoin(F.broadcast(best)).select(       # one row
        "s", F.when(F.col("step") >= F.col("least"), "allow").otherwise("block").alias("scored"))
    return rows.join(verdicts, "s", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", "scored", F.lit("allow")).alias("verdict"))


def oracle(rules=RULES) -> str:
    """The same as DuckDB SQL over `pages`."""
    def case(value):
        arms = []
        for said, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
            h, _, p = r.partition("/")
            arms.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r if value == 'rule' else said}'")
        return "CASE " + " ".join(arms) + " END"

    steps = []
    for k in range(ORDER + 1):
        def mixed(p, n, total, kinds):
            return (f"CASE WHEN coalesce(c.{total}, 0) + coalesce(c.{kinds}, 0) > 0 THEN "
                    f"(coalesce(g.{n}, 0) + c.{kinds} * p.{p}) / (c.{total} + c.{kinds}) ELSE p.{p} END AS {p}")
        steps.append(f"""p{k + 1} AS (SELECT p.run, {mixed('pa', 'a', 'na', 'ta')}, {mixed('pb', 'b', 'nb', 'tb')}
 FROM p{k} p LEFT JOIN grams g ON length(p.run) > {k} AND g.gram = right(p.run, {k + 1})
 LEFT JOIN contexts c ON length(p.run) > {k} AND c.context = left(right(p.run, {k + 1}), {k}))""")
    runs = f"substr(s, greatest(1, i - {ORDER}), least({ORDER + 1}, i))"
    return f"""WITH cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, {case('rule')} AS rule, {case('said')} AS said, host || path AS s FROM rows),
texts AS (SELECT s, said, count(*) AS n, CASE WHEN substr(md5(s), 1, 1) < '8' THEN 0 ELSE 1 END AS half FROM ruled WHERE s <> '' GROUP BY s, said),
train AS (SELECT {runs} AS run, CASE WHEN said = 'allow' THEN n ELSE 0 END AS a, CASE WHEN said = 'block' THEN n ELSE 0 END AS b
 FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM texts WHERE said IS NOT NULL AND half = 0)),
grams AS (SELECT right(run, k) AS gram, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT *, unnest(range(1, length(run) + 1)) AS k FROM train) GROUP BY 1),
contexts AS (SELECT left(gram, length(gram) - 1) AS context, sum(a)::BIGINT AS na, count(*) FILTER (a > 0) AS ta, sum(b)::BIGINT AS nb, count(*) FILTER (b > 0) AS tb FROM grams GROUP BY 1),
asked AS (SELECT * FROM texts WHERE said IS NULL OR half = 1),
occurs AS (SELECT s, {runs} AS run FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM asked)),
p0 AS (SELECT DISTINCT run, 1.0::DOUBLE / {ALPHABET} AS pa, 1.0::DOUBLE / {ALPHABET} AS pb FROM occurs),
{', '.join(steps)},
ratios AS (SELECT run, round((ln(pa) - ln(pb)) * 1e6)::BIGINT AS ratio FROM p{ORDER + 1}),
steps AS (SELECT t.s, t.said, t.n, floor(x.total::DOUBLE / length(t.s) / {STEP})::BIGINT AS step
 FROM (SELECT s, sum(ratio)::BIGINT AS total FROM occurs JOIN ratios USING (run) GROUP BY s) x JOIN texts t USING (s)),
bins AS (SELECT step, sum(CASE WHEN said = 'allow' THEN n ELSE 0 END)::BIGINT AS a, sum(CASE WHEN said = 'block' THEN n ELSE 0 END)::BIGINT AS b FROM steps WHERE said IS NOT NULL GROUP BY step),
sums AS (SELECT step, coalesce(floor((step + lead(step) OVER (ORDER BY step DESC)) / 2.0)::BIGINT + 1, step) AS least, sum(a) OVER (ORDER BY step DESC)::BIGINT AS ca, sum(b) OVER (ORDER BY step DESC)::BIGINT AS cb, sum(a) OVER ()::BIGINT AS ta, sum(b) OVER ()::BIGINT AS tb FROM bins),
best AS (SELECT coalesce((SELECT least FROM sums WHERE ta > 0 AND tb > 0 ORDER BY round(ca::DOUBLE / ta - cb::DOUBLE / tb, 9) DESC, abs(step), step DESC LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(r.said, CASE WHEN step >= least THEN 'allow' WHEN step < least THEN 'block' END, 'allow') AS verdict
FROM ruled r LEFT JOIN (SELECT s, step FROM steps WHERE said IS NULL) x ON r.s = x.s CROSS JOIN best"""
