"""URL filters: rules on hosts and paths first, then logistic regression on hashed character n-grams of host and path.

Everything runs on DataFrame functions. A url is split at its first ``://``; its distinct grams of SPANS characters,
those of the host apart from those of the path and digits all alike, are hashed to BUCKETS features of equal weight, which make
a vector of length one. The regression is learned from a small labelled table, brought into one row, by accelerated gradient
steps within one expression; only the weights (BUCKETS numbers at most) come to the driver. Judging is a projection of
the pages, without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path and no grams, so the bias alone judges it,
and without labels all are allowed. Repeated rows are judged alike. Other columns of the pages, whatever their
names, take no part. Of rules that fit, the longest wins (host and path together), of equally long ones the later in
code point order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

SPANS = (3, 4, 5)
BUCKETS = 16_384
#: Labelled urls that are learned from at most, by the least hash of the url: a bound of the sample.
LABELLED = 5_000
STEPS, PENALTY = 200, 3e-4
#: An allowed row counts as so many: most urls are to be allowed, so one without known grams is.
ALLOWED_WEIGHT = 4.0

#: The rules of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: A small labelled table: what block lists name (advertising, betting, adult, pills, spam, pirated files) and what they do not.
BLOCKED = """
http://ads.banner-network.example/en/12.html https://track.clicks.example/fr/9?utm_source=feed http://adserver.media.example/de/77/ https://www.popup-ads.example/en/1#top http://ad-tracker.example/es/4031
https://pixel-track.example/en/88.html http://m.tracking-ads.example/en/552 https://casino-royal.example/en/5 http://www.online-casino.example/de/812.html https://blog.casinowin.example/fr/3?page=2 http://win-slots.example/en/44/
https://m.poker-win.example/es/102 http://jackpot-win.example/en/9 https://big-win.example/en/731.html http://free-bet.example/en/32 https://www.sport-bets.example/fr/88 http://bets-now.example/de/5?ref=x https://live-bets.example/en/700
http://freebets.example/es/64.html https://free-spins.example/en/18 http://www.free-cash.example/en/2 https://cheap-meds.example/en/71 http://pills-shop.example/de/30.html https://www.buy-pills.example/fr/12 http://cheap-viagra.example/en/900
https://m.diet-pills.example/en/41?utm_source=feed http://cheap-watches.example/es/8/ https://cheappills.example/en/65 http://spam.example/en/3 https://www.spam-links.example/de/17 http://link-farm.example/en/52.html https://content-farm.example/fr/6
http://m.spamhost.example/en/1123 https://seo-farm.example/es/29#top http://adult.example/en/14 https://www.adult-video.example/en/210.html http://m.adult-chat.example/fr/4 https://xxx-adult.example/de/91 http://sex-x.example/en/7
https://porn-x.example/en/38?page=2 http://www.xxx-tube.example/es/66 https://escort-x.example/en/5/ http://warez.example/en/83 https://www.crack-keygen.example/de/2.html http://torrent-crack.example/fr/19 https://payday-loan.example/en/47
http://quick-loans.example/en/602 https://make-money-fast.example/es/13 http://crypto-giveaway.example/en/20.html https://click-bait.example/en/99?ref=x http://phishing-login.example/de/4
"""
ALLOWED = """
http://www.news.example/en/12.html https://blog.garden.example/fr/9?utm_source=feed http://weather.example/de/77/ https://www.university.example/en/1#top http://library.example/es/4031 https://museum-city.example/en/88.html
http://m.recipes.example/en/552 https://science-daily.example/en/5 http://www.history.example/de/812.html https://blog.travel.example/fr/3?page=2 http://the-times.example/en/44/ https://m.football.example/es/102 http://music.example/en/9
https://big-garden.example/en/731.html http://free-software.example/en/32 https://www.free-press.example/fr/88 http://open-data.example/de/5?ref=x https://live-news.example/en/700 http://hospital.example/es/64.html https://health-info.example/en/18
http://www.mathematics.example/en/2 https://cinema.example/en/71 http://book-shop.example/de/30.html https://www.court-records.example/fr/12 http://parliament.example/en/900 https://m.physics.example/en/41?utm_source=feed
http://wind-energy.example/es/8/ https://winter-sports.example/en/65 http://farming.example/en/3 https://www.farmers-union.example/de/17 http://the-thing.example/en/52.html https://nation-station.example/fr/6 http://m.theory.example/en/1123
https://education.example/es/29#top http://better-cities.example/en/14 https://www.alphabets.example/en/210.html http://m.adoption.example/fr/4 https://trackside-trains.example/de/91 http://essex-county.example/en/7 https://oxford-x.example/en/38?page=2
http://www.tube-map.example/es/66 https://railway.example/en/5/ http://software.example/en/83 https://www.grammar-key.example/de/2.html http://theatre.example/fr/19 https://payments-guide.example/en/47 http://quick-recipes.example/en/602
https://translation.example/es/13 http://cryptography.example/en/20.html https://chess-club.example/en/99?ref=x http://www.ethics.example/de/4 http://chat-help.example/en/31 https://www.hosting-guide.example/es/7.html http://what-and-that.example/fr/58 https://first-host.example/de/6
"""


def labelled(spark: SparkSession) -> DataFrame:
    """url, label (1: block) of the small labelled table."""
    rows = json.dumps([{"url": u, "label": k} for k, text in ((1, BLOCKED), (0, ALLOWED)) for u in text.split()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<url:string,label:int>>")))


def host(url: Column) -> Column:
    """What stands behind the first :// up to / ? # or the end, with A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What stands behind the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: Column, path: Column) -> Column:
    """The distinct buckets of all grams, in linear time of the url's length."""
    plain = lambda side, text: F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]", "0"), F.lit("$"))
    found = lambda side, text: F.transform(F.flatten(F.array(*[F.regexp_extract_all(plain(side, text), F.lit(rf"(?s)(?=(.{{{n}}}))"), 1) for n in SPANS])), lambda g: F.concat(F.lit(side), g))
    bucket = lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(BUCKETS)).cast("int")
    grams = F.concat(F.when(host != "", found("h", host)).otherwise(F.array().cast("array<string>")), F.when(path != "", found("p", path)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.transform(grams, bucket))


@dataclass
class Model:
    """weights: one number a bucket."""

    weights: list[float]
    bias: float

    def score(self, features: Column) -> Column:
        """The probability that a url is to be blocked."""
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        total = F.aggregate(features, F.lit(0.0), lambda s, b: s + F.get(weights, b))
        return 1 / (1 + F.exp(-(self.bias + total / F.sqrt(F.greatest(F.size(features), F.lit(1))))))


#: One accelerated gradient step: w, b are where the gradient is taken, v, c the last point, t the pace. The loss of unit
#: vectors and a bias bends by a half at most, so a step of 2 is safe. r holds the residuals of all examples.
_STEP = """
element_at(transform(array(
  transform(examples, e -> (1 / (1 + exp(-(s.b + e.x * aggregate(e.f, 0D, (a, j) -> a + s.w[j])))) - e.y) * e.c)
), r -> element_at(transform(array(named_struct(
  'v', transform(grams, (g, j) -> s.w[j] - 2 * (aggregate(g.rows, 0D, (a, i) -> a + r[i] * examples[i].x) + {penalty}D * s.w[j])),
  'c', s.b - 2 * aggregate(r, 0D, (a, x) -> a + x),
  't', (1 + sqrt(1 + 4 * s.t * s.t)) / 2
)), n -> named_struct('w', zip_with(n.v, s.v, (p, q) -> p + (s.t - 1) / n.t * (p - q)), 'b', n.c + (s.t - 1) / n.t * (n.c - s.c), 'v', n.v, 'c', n.c, 't', n.t)), 1)), 1)
"""
_FIT = """aggregate(sequence(1, {steps}), named_struct('w', transform(grams, g -> 0D), 'b', 0D, 'v', transform(grams, g -> 0D), 'c', 0D, 't', 1D), (s, k) -> """ + _STEP + """)"""


def learn(labels: DataFrame, url_col: str = "url", label_col: str = "label", steps: int = STEPS) -> Model:
    """A model of a small table of urls and labels (1: block). Rows without a url or a label take no part; a url that repeats counts as
    often as it stands there."""
    scratch, url = Scratch(labels.sparkSession), F.col(url_col)
    rows = labels.where(url.isNotNull() & F.col(label_col).isNotNull()).select(url.alias("url"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("url"), "url", "y").limit(LABELLED)
    rows = rows.select("y", features(host(F.col("url")), path(F.col("url"))).alias("features")).coalesce(1).withColumn("i", F.monotonically_increasing_id().cast("int"))
    # The numbers of the rows must stay: they are written before they are used twice. One partition needs no shuffle.
    rows = scratch.save(rows).coalesce(1)
    grams = rows.select("i", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.collect_list("i").alias("rows")).groupBy().agg(F.array_sort(F.collect_list(F.struct("bucket", "rows"))).alias("grams"))
    own = F.transform(F.filter(F.transform("grams", lambda g, j: F.struct(j.alias("j"), F.array_contains(g["rows"], F.col("i")).alias("has"))), lambda g: g["has"]), lambda g: g["j"])
    count = F.when(F.col("y") == 0, ALLOWED_WEIGHT).otherwise(1.0)
    example = F.struct("i", own.alias("f"), (1 / F.sqrt(F.greatest(F.size("features"), F.lit(1)))).alias("x"), "y", count.alias("c"))
    one = rows.join(F.broadcast(grams)).groupBy().agg(F.array_sort(F.collect_list(example)).alias("examples"), F.first("grams").alias("grams"), F.sum(count).alias("n"))
    one = one.withColumn("examples", F.transform("examples", lambda e: F.struct(e["f"].alias("f"), e["x"].alias("x"), e["y"].alias("y"), (e["c"] / F.col("n")).alias("c"))))
    fit = one.where("n > 0").select(F.expr(_FIT.format(steps=steps, penalty=PENALTY)).alias("s"), F.col("grams.bucket").alias("buckets")).select("s.v", "s.c", "buckets").collect()
    scratch.drop(rows)
    known = dict(zip(fit[0].buckets, fit[0].v)) if fit else {}
    return Model([known.get(b, 0.0) for b in range(BUCKETS)], fit[0].c if fit else -1.0)


def rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct with its name and verdict; null where none does."""
    rows = json.dumps([{"size": len(h + p), "name": h + p, "verdict": v, "host": h, "path": p} for v, h, p in rules])
    known = F.from_json(F.lit(rows), "array<struct<size:int,name:string,verdict:string,host:string,path:string>>")
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.array_max(F.filter(known, fits))


def judge(pages: DataFrame, model: Model, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score (of the model: the probability of block) of every page. rules is a short list, which each url is held
    against."""
    split = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    told = split.select("page_id", "host", "path", rule(F.col("host"), F.col("path"), rules).alias("r"), model.score(features(F.col("host"), F.col("path"))).alias("score"))
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return told.select(F.col("page_id").alias(id_col), "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", by_model).alias("verdict"), "score")
