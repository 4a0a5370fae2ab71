"""URL filter: rules by host and path, and gradient-boosted trees for the URLs they leave open.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
lower case; its path goes on from there to ``?``, ``#`` or the end. A rule (verdict, host,
path) fits its host and all subdomains where the path starts with the rule's; of the rules
that fit, the longest decides.

The trees see lexical features only: lengths, depth, digit ratio, character entropy, parameter
counts and the like, and statistics of suffixes: how often labelled URLs end in the same host
labels, file ending or start of the path, and which share of them is blocked. Those names are
hashed to ``BUCKETS`` buckets a kind, so the tables of statistics have at most that many rows,
whatever the URLs hold, and are broadcast. They come from one half of the labelled URLs (by a
hash of the URL), the trees from the other, so no label reaches its own row's features. The fit
takes at most about ``TRAIN_URLS`` distinct labelled URLs, chosen by their hash; scores cover
every row and need no shuffle.

Defined cases: a null URL, or one without ``://``, has an empty host and path, and its features
are those of its text (null: empty). Labels that contradict each other for one URL count as
their majority, a tie as blocked. Labels of one kind only give that verdict; without labels all
is allowed. URLs of any length are used whole. Repeated rows are judged alike, an empty table gives an empty
result, and further columns are kept aside: only the id and URL columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: rows of a table of suffix statistics
BUCKETS = 4096
#: distinct labelled URLs that a fit takes, about
TRAIN_URLS = 200_000
#: weight of the overall share in a suffix's own
PRIOR = 5.0
TREES, DEPTH, STEP = 20, 4, 0.2
THRESHOLD = 0.5

PARTS = {
    "_text": "coalesce(_url, '')",
    "_after": "CASE WHEN instr(_text, '://') > 0 THEN substr(_text, instr(_text, '://') + 3) ELSE '' END",
    "_raw": "regexp_extract(_after, '^[^/?#]*', 0)",
    "host": f"translate(_raw, '{UPPER}', '{UPPER.lower()}')",
    "_rest": "substr(_after, length(_raw) + 1)",
    "path": "regexp_extract(_rest, '^[^?#]*', 0)",
    "_query": "regexp_extract(_rest, '^[^?#]*[?]([^#]*)', 1)",
}

FEATURES = {
    "f_length": "length(_text)",
    "f_host_length": "length(host)",
    "f_path_length": "length(path)",
    "f_query_length": "length(_query)",
    "f_depth": "regexp_count(path, '[^/]+')",
    "f_labels": "CASE host WHEN '' THEN 0 ELSE regexp_count(host, '[.]') + 1 END",
    "f_digit_ratio": "regexp_count(_text, '[0-9]') / greatest(length(_text), 1)",
    "f_host_digits": "regexp_count(host, '[0-9]')",
    "f_upper_ratio": "regexp_count(_text, '[A-Z]') / greatest(length(_text), 1)",
    "f_hyphens": "regexp_count(host, '-')",
    "f_marks": "regexp_count(_text, '[%@_~=&]')",
    "f_parameters": "CASE _query WHEN '' THEN 0 ELSE regexp_count(_query, '&') + 1 END",
    "f_longest_part": "array_max(transform(split(path, '/'), x -> length(x)))",
    "f_entropy": "aggregate(array_distinct(split(_text, '')), 0D, (sum, c) -> sum + CASE c WHEN '' THEN 0D ELSE"
    " (length(_text) - length(replace(_text, c, ''))) / length(_text)"
    " * log2(length(_text) / (length(_text) - length(replace(_text, c, '')))) END)",
    "f_secure": "CASE WHEN startswith(lower(_text), 'https:') THEN 1 ELSE 0 END",
    "f_fragment": "CASE WHEN contains(_text, '#') THEN 1 ELSE 0 END",
}

#: names whose statistics are features
SUFFIXES = {
    "last": "substring_index(host, '.', -1)",
    "domain": "substring_index(host, '.', -2)",
    "ending": "regexp_extract(path, '[.]([A-Za-z0-9]{1,8})$', 1)",
    "start": "regexp_extract(path, '^/([^/]*)', 1)",
    "last_start": "concat(substring_index(host, '.', -1), '/', regexp_extract(path, '^/([^/]*)', 1))",
}


def in_steps(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns that use one another, each worked out once a row.

    A generator of one row keeps later filters and selections from copying the
    expressions in.
    """
    for name, text in columns.items():
        df = df.select("*", F.explode(F.array(F.expr(text))).alias(name))
    return df


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with host and path, and working columns whose names start with ``_``."""
    return in_steps(df.withColumn("_url", F.col(url_col).cast("string")), PARTS)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


def rule_of(text: str) -> Rule:
    """From text such as ``block example.org/es/``."""
    verdict, target = text.split(maxsplit=1)
    if verdict not in ("allow", "block"):
        raise ValueError(f"a rule allows or blocks: {text!r}")
    host, slash, path = target.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def with_rules(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    """``parts`` with ``rule`` and ``rule_verdict``, null where no rule fits; ties go to the first in the list."""
    nothing = F.lit(None).cast("string")
    best = sorted(rules, key=lambda rule: -len(rule.name))
    names = [F.when(rule.fits(), F.lit(rule.name)) for rule in best]
    verdicts = [F.when(rule.fits(), F.lit(rule.verdict)) for rule in best]
    return parts.withColumns(
        {"rule": F.coalesce(*names, nothing), "rule_verdict": F.coalesce(*verdicts, nothing)}
    )


def bucket(name: str) -> Column:
    return F.expr(f"CAST(pmod(xxhash64({SUFFIXES[name]}), {BUCKETS}) AS INT)")


@dataclass(frozen=True)
class UrlModel:
    """Statistics of suffixes by bucket, trees over features; ``trees`` is null where ``constant`` decides."""

    statistics: dict[str, DataFrame]
    share: float
    trees: object | None
    constant: float

    def features(self, parts: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        rows = in_steps(parts, {name: f"CAST({text} AS DOUBLE)" for name, text in FEATURES.items()})
        names = list(FEATURES)
        for name, table in self.statistics.items():
            rows = rows.withColumn("_bucket", bucket(name))
            # at most BUCKETS rows
            rows = rows.join(F.broadcast(table), "_bucket", "left").drop("_bucket")
            rows = rows.fillna({f"s_{name}_count": 0.0, f"s_{name}_share": self.share})
            names += [f"s_{name}_count", f"s_{name}_share"]
        return VectorAssembler(inputCols=names, outputCol="_features").transform(rows)

    def scored(self, parts: DataFrame) -> DataFrame:
        """``parts`` with ``score``: from 0 (allow) to 1 (block)."""
        if self.trees is None:
            return parts.withColumn("score", F.lit(self.constant))
        from pyspark.ml.functions import vector_to_array

        rows = self.trees.transform(self.features(parts))
        score = vector_to_array("probability")[1]
        return rows.select(*parts.columns, score.alias("score"))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most: int = TRAIN_URLS) -> UrlModel:
    """Train on rows with a URL and a label: blocked (true) or not; null labels are left out."""
    from pyspark.ml.classification import GBTClassifier

    known = labelled.where(F.col(label_col).isNotNull())
    known = known.groupBy(F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    known = known.agg((2 * F.sum(F.col(label_col).cast("int")) >= F.count("*")).cast("double").alias("label"))
    known = stored(known.withColumn("_hash", F.xxhash64("_url", F.lit(11))))
    total = known.count()
    if total > most:
        known = known.where(F.expr(f"pmod(_hash, 1000003) < {1_000_003 * most // total}"))
    n, blocked = known.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0.0, float(n)):
        return UrlModel({}, 0.0, None, 1.0 if n and blocked else 0.0)
    share = blocked / n
    parts = stored(url_parts(known.select("_url", "label", "_hash"), "_url"))
    first = F.expr("_hash % 2 = 0")
    statistics = {}
    for name in SUFFIXES:
        counts = parts.where(first).groupBy(bucket(name).alias("_bucket"))
        counts = counts.agg(F.count("*").alias("n"), F.sum("label").alias("b"))
        statistics[name] = stored(
            counts.select(
                "_bucket",
                F.log1p("n").alias(f"s_{name}_count"),
                ((F.col("b") + PRIOR * share) / (F.col("n") + PRIOR)).alias(f"s_{name}_share"),
            )
        )
    model = UrlModel(statistics, share, None, share)
    rows = stored(model.features(parts.where(~first)).select("_url", "label", "_features"))
    halves = rows.agg(F.min("label"), F.max("label")).first()
    if halves[0] is None or halves[0] == halves[1]:
        # too few URLs to part them: the share among all decides
        return model
    trees = GBTClassifier(
        featuresCol="_features",
        labelCol="label",
        maxIter=TREES,
        maxDepth=DEPTH,
        stepSize=STEP,
        maxBins=64,
        seed=11,
    ).fit(rows)
    return UrlModel(statistics, share, trees, share)


def judged(
    pages: DataFrame,
    rules: list[Rule],
    labelled: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    most: int = TRAIN_URLS,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score.

    ``labelled`` (url, blocked) are the labels that the trees learn from; by default
    the URLs that the rules decide, with their verdicts.
    """
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    parts = with_rules(url_parts(chosen, "_url"), rules)
    if labelled is None:
        decided = parts.where("rule_verdict IS NOT NULL")
        labelled = decided.select(F.col("_url").alias("url"), F.expr("rule_verdict = 'block'").alias("blocked"))
    rows = fit(labelled, most=most).scored(parts)
    method = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "score"
    )
