"""URL filter by a path-template tree.

1. Fixed rules (host and path prefix) judge the URLs they fit and label them
   for what follows.
2. Per host, paths form a tree of segments. A segment of digits, hex or mixed
   letters and digits is a wildcard at once; level by level from the host, a
   node with many children, none of them frequent, makes them one wildcard, and
   their branches one branch. What is left are templates.
3. Sibling templates (equal but for the last fixed segment) whose labelled
   shares do not differ from their parent's by a two-proportion test are
   merged into it.
4. A template is rejected when its smoothed share of blocked labels reaches
   the threshold; an URL without a rule gets its template's verdict. The share
   is smoothed towards that of the branch above, from the labels outside the
   template, up to the host and at last a constant: a template without labels
   has the share of what lies around it.

Counts are partial sums per (host, path form), so a host with a third of all
pages is one small group per map task.

Defined results: a null URL or one without ``://`` has an empty host and path
and is judged by the template of the empty host (allowed unless its labels say
otherwise); repeated rows are judged alike; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import LOWER, UPPER, col, written

# The rules, in order of their text.
RULES = (
    ("com/de/", "block"),
    ("com/fr/", "allow"),
    ("example.org/en/1", "block"),
    ("example.org/es/", "block"),
    ("org/", "allow"),
)
MANY = 16        # a node with so many children,
RARE = 0.2       # none with a larger share of its pages, is a wildcard
ALIKE = 3.84     # squared z of the two-proportion test (95 %)
PRIOR_ROWS = 4.0  # weight of the prior in the smoothed share
PRIOR_BLOCK = 0.5
REJECT = 0.8

_VARIABLE = r"^(?:[0-9]+|[0-9a-f]{8,}|(?:[A-Za-z_-]*[0-9]){3,}[A-Za-z_-]*)(\.[A-Za-z]{1,5})?$"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def path_form(path: Column) -> Column:
    """The path with segments of digits, hex or mixed text made wildcards."""
    parts = F.array_remove(F.split(path, "/"), "")
    forms = F.transform(parts, lambda s: F.when(s.rlike(_VARIABLE), F.lit("*")).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(forms, "/"))


def generalised(forms: DataFrame) -> DataFrame:
    """(host, form, parts): the segments of every path form, from the host down
    level by level, a wildcard where the node above has many children. A node's
    children are counted over all pages under its generalised path, so what
    varies below something that varies is found as well. A path goes on to the
    next level while ``MANY`` forms share its generalised path: with fewer, no
    node below has as many children."""
    level = forms.select("host", "form", "pages", F.filter(F.split("form", "/"), lambda s: s != "").alias("parts"))
    done, depth = [], 0
    while True:
        above = F.array_join(F.slice("parts", 1, depth), "/") if depth else F.lit("")
        held = level.select("*", above.alias("above"), F.get("parts", F.lit(depth)).alias("segment"))
        nodes = (held.filter(col("segment").isNotNull())
                 .groupBy("host", "above", "segment").agg(F.sum("pages").alias("pages"), F.count("*").alias("forms"))
                 .groupBy("host", "above").agg(F.count("*").alias("children"), F.sum("pages").alias("pages"),
                                               F.max("pages").alias("largest"), F.sum("forms").alias("forms")))
        crowded = nodes.filter(col("forms") >= MANY).select(
            "host", "above", ((col("children") >= MANY) & (col("largest") <= col("pages") * RARE)).alias("wide"))
        parts = F.transform("parts", lambda s, i: F.when((i == depth) & col("wide"), F.lit("*")).otherwise(s))
        depth += 1
        told = written(held.join(crowded, ["host", "above"], "left").select(
            "host", "form", "pages", F.when(col("wide"), parts).otherwise(col("parts")).alias("parts"),
            (col("wide").isNotNull() & (F.size("parts") > depth)).alias("on")), "url-level")
        done.append(told.filter(~col("on")).select("host", "form", "parts"))
        level = told.filter("on").drop("on")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, done)


def templates(judged: DataFrame) -> DataFrame:
    """(host, form, template, verdict) of every path form, from a table
    (host, form, rule verdict or null)."""
    forms = written(judged.groupBy("host", "form").agg(
        F.count("*").alias("pages"), F.count("label").alias("labelled"),
        F.count(F.when(col("label") == "block", 1)).alias("blocked")), "url-forms")

    named = generalised(forms)
    # The parent: the last fixed segment made a wildcard.
    fixed = F.array_max(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.when(
        (i < F.size("parts")) & (F.get(col("parts"), i) != "*"), i)))
    named = named.withColumn("fixed", fixed)
    merged = F.transform("parts", lambda s, i: F.when(i == col("fixed"), F.lit("*")).otherwise(s))
    named = named.select("host", "form", F.concat(F.lit("/"), F.array_join("parts", "/")).alias("own"),
                         F.concat(F.lit("/"), F.array_join(F.when(col("fixed").isNull(), col("parts")).otherwise(merged), "/")).alias("parent"))
    counted = written(named.join(forms, ["host", "form"]), "url-templates")

    own = counted.groupBy("host", "own", "parent").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    families = own.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    both = own.join(families, ["host", "parent"])
    rest_n, rest_b = col("all_n") - col("n"), col("all_b") - col("b")
    pooled = col("all_b") / col("all_n")
    gap = col("b") / col("n") - rest_b / rest_n
    z2 = gap * gap / (pooled * (1 - pooled) * (1 / col("n") + 1 / rest_n))
    # A branch without labels, or with the only labels, is like no other.
    alike = (F.when((col("n") == 0) | (rest_n == 0), False).when((col("all_b") == 0) | (col("all_b") == col("all_n")), True)
             .otherwise(z2 < ALIKE))
    both = both.withColumn("template", F.when(alike, col("parent")).otherwise(col("own")))
    final = verdicts(both.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    chosen = both.select("host", "own", "parent", "template").join(final, ["host", "template"])
    return written(counted.select("host", "form", "own", "parent").join(chosen, ["host", "own", "parent"])
                   .select("host", "form", "template", "verdict"), "url-verdicts")


def verdicts(counted: DataFrame) -> DataFrame:
    """(host, template, verdict) from a table (host, template, n labels, b of
    them blocked). Each label counts once, at the lowest branch it shares with
    the template."""
    parts = F.filter(F.split("template", "/"), lambda s: s != "")
    # Every template in each branch above it: the host (depth 0) to its own path.
    steps = counted.select("*", parts.alias("parts")).select(
        "host", "template", "n", "b", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts")
    steps = steps.select("host", "template", "n", "b", "depth", F.array_join(F.slice("parts", F.lit(1), col("depth")), "/").alias("branch"))
    branches = steps.groupBy("host", "branch").agg(F.sum("n").alias("branch_n"), F.sum("b").alias("branch_b"))
    chain = F.array_sort(F.collect_list(F.struct("depth", col("branch_n").alias("n"), col("branch_b").alias("b"))))
    chains = steps.join(branches, ["host", "branch"]).groupBy("host", "template").agg(
        F.first("n").alias("n"), F.first("b").alias("b"), chain.alias("chain"))
    # What each branch holds outside the next one below, the last outside the template itself.
    below = F.concat(F.transform(F.slice("chain", F.lit(2), F.size("chain")), lambda x: F.struct(x["n"].alias("n"), x["b"].alias("b"))),
                     F.array(F.struct("n", "b")))
    apart = F.zip_with("chain", below, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), (x["b"] - y["b"]).alias("b")))
    share = F.aggregate(F.concat(apart, F.array(F.struct("n", "b"))), F.lit(PRIOR_BLOCK),
                        lambda prior, x: (x["b"] + PRIOR_ROWS * prior) / (x["n"] + PRIOR_ROWS))
    return chains.select("host", "template", F.when(share >= REJECT, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every page."""
    read = pages.select(col(page_id).alias("page"), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    read = read.select("*", matched_rule(col("host"), col("path"), rules).alias("match"), path_form(col("path")).alias("form"))
    learned = templates(read.select("host", "form", col("match")["verdict"].alias("label")))
    return (read.join(learned, ["host", "form"], "left")
            .select(col("page").alias(page_id), "host", "path", col("match")["rule"].alias("rule"),
                    F.coalesce(col("match")["verdict"], col("verdict")).alias("verdict"), "template"))
