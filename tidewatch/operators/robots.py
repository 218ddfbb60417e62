"""Robots files as tables: parse bodies to rules, join URLs to them and decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up, squeeze_ends


def robots_rules(bodies: DataFrame, key: str, agent: str, body: str = "body") -> DataFrame:
    """One row per body: (key, user_agent, allow, disallow, crawl_delay) for our agent.

    A user-agent line behind any rule starts a group; rules before the first agent belong
    to ``*``. The first group naming a part of our agent beats the first ``*`` group.
    Windows run inside one body, which is one cell of the input.
    """
    c = F.col
    text = F.split(c(body), r"\r?\n")
    lines = bodies.select(F.col(key), F.posexplode(text).alias("line_no", "line"))
    line = squeeze_ends(F.regexp_replace("line", "#.*$", ""))
    fields = lines.select(
        key,
        "line_no",
        F.lower(squeeze_ends(F.substring_index(line, ":", 1))).alias("field"),
        squeeze_ends(F.regexp_replace(line, "(?s)^[^:]*:", "")).alias("value"),
        line.contains(":").alias("pair"),
    ).filter("pair and (field in ('user-agent', 'disallow') or value <> '')")
    order = Window.partitionBy(key).orderBy("line_no")
    is_agent = c("field") == "user-agent"
    before = F.lag("field").over(order)
    starts = is_agent & (before.isNull() | (before != "user-agent"))
    grouped = fields.withColumn("grp", F.sum(starts.cast("int")).over(order))
    delay = F.when(c("field") == "crawl-delay", c("value").try_cast("double"))
    # Any other field only closes the agent lines of its group.
    keep = lambda name: F.transform(
        F.sort_array(F.collect_list(F.when(c("field") == name, F.struct("line_no", "value")))),
        lambda item: item["value"],
    )
    groups = grouped.groupBy(key, "grp").agg(
        keep("user-agent").alias("agents"),
        keep("allow").alias("allow"),
        keep("disallow").alias("disallow"),
        F.max_by(delay, F.when(delay.isNotNull(), c("line_no"))).alias("crawl_delay"),
    )
    names = F.when(c("grp") == 0, F.array(F.lit("*"))).otherwise(
        F.transform(F.filter("agents", lambda a: a != ""), lambda a: F.lower(a))
    )
    ours = F.exists("agents", lambda a: (a != "*") & F.lit(agent.lower()).contains(a))
    rank = F.when(ours, 0).when(F.array_contains("agents", "*"), 1)
    chosen = (
        groups.withColumn("agents", names)
        .withColumn("rank", rank)
        .groupBy(key)
        .agg(
            F.min_by(
                F.struct("rank", "agents", "allow", "disallow", "crawl_delay"),
                F.when(c("rank").isNotNull(), F.struct("rank", "grp")),
            ).alias("g")
        )
    )
    none = F.array().cast("array<string>")
    return bodies.select(key).join(chosen, key, "left").select(
        key,
        F.when(c("g").isNull(), agent.lower())
        .when(c("g.rank") == 0, F.get("g.agents", F.lit(0)))
        .otherwise("*")
        .alias("user_agent"),
        F.coalesce("g.allow", none).alias("allow"),
        F.coalesce("g.disallow", none).alias("disallow"),
        c("g.crawl_delay").alias("crawl_delay"),
    )


def path_matches(path: Column, pattern: Column) -> Column:
    """Prefix match with ``*`` and a final ``$``; an empty pattern matches nothing."""
    anchored = pattern.endswith("$")
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.concat(F.lit(r"^\Q"), F.regexp_replace(body, r"\*", r"\\E.*\\Q"), F.lit(r"\E"))
    regex = F.when(anchored, F.concat(quoted, F.lit("$"))).otherwise(quoted)
    return (
        F.when(pattern == "", F.lit(False))
        .when(~pattern.contains("*") & ~anchored, F.startswith(path, pattern))
        .otherwise(F.regexp_like(path, regex))
    )


def longest_match(path: Column, patterns: Column) -> Column:
    """Length of the longest matching pattern, -1 without one."""
    return F.aggregate(
        patterns,
        F.lit(-1),
        lambda best, p: F.when(path_matches(path, p), F.greatest(best, F.length(p))).otherwise(best),
    )


def decide_path(path: Column, allow: Column, disallow: Column) -> Column:
    """struct(allowed, reason): the longest match wins, a tie refuses, none allows."""
    best = F.struct(
        longest_match(path, allow).alias("yes"), longest_match(path, disallow).alias("no")
    )
    reason = (
        F.when((best["yes"] == -1) & (best["no"] == -1), "no_rules")
        .when(best["yes"] > best["no"], "allow")
        .otherwise("disallow")
    )
    return F.struct((reason != "disallow").alias("allowed"), reason.alias("reason"))


# Many rules per origin ----------------------------------------------------------


def rule_index(rules: DataFrame, key: str) -> DataFrame:
    """(key, prefix, kind, pattern): every rule under the text in front of its first ``*`` or final ``$``.

    ``pattern`` is null for a plain prefix, which its prefix says whole; ``size`` is the length that counts.
    """
    own = [rules.select(key, F.lit(kind).alias("kind"), F.explode(kind).alias("pattern")) for kind in ("allow", "disallow")]
    listed = own[0].unionByName(own[1])
    wild = F.contains(F.col("pattern"), F.lit("*")) | F.col("pattern").endswith("$")
    literal = F.substring_index(F.regexp_replace("pattern", r"\$$", ""), "*", 1)
    return (
        listed.filter("pattern <> ''")
        .select(
            key,
            literal.alias("prefix"),
            "kind",
            F.when(wild, F.col("pattern")).alias("pattern"),
            F.length("pattern").alias("size"),
        )
        .distinct()
    )


def path_decisions(urls: DataFrame, rules: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, path, allowed, reason) of every distinct path of ``urls``, for origins with many rules.

    A path meets the rules of its origin by an equi-join on the prefixes it has: it is cut at the lengths
    that some rule of the origin has, so it costs a row per such length and no pattern is tried but those
    with a ``*`` or ``$`` behind a prefix that fits. The longest match per kind is a grouped maximum.
    """
    index = rule_index(rules, key)
    # One row per origin, with as many numbers as its rules have lengths.
    lengths = index.groupBy(key).agg(F.collect_set(F.length("prefix")).alias("lengths"))
    own = urls.select(key, F.col(path).alias("path")).distinct()
    cut = own.join(lengths, key, "left").select(
        key, "path", F.explode_outer(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")
    )
    met = cut.withColumn("prefix", F.expr("substring(path, 1, n)")).join(index, [key, "prefix"], "left")
    fits = F.col("kind").isNotNull() & (F.col("pattern").isNull() | path_matches(F.col("path"), F.col("pattern")))
    longest = lambda kind: F.coalesce(F.max(F.when(fits & (F.col("kind") == kind), F.col("size"))), F.lit(-1))
    best = met.groupBy(key, "path").agg(longest("allow").alias("yes"), longest("disallow").alias("no"))
    reason = F.when((F.col("yes") == -1) & (F.col("no") == -1), "no_rules").when(F.col("yes") > F.col("no"), "allow").otherwise("disallow")
    return best.select(key, F.col("path").alias(path), reason.alias("reason")).withColumn("allowed", F.col("reason") != "disallow")


def robots_decisions(
    urls: DataFrame,
    robots: DataFrame,
    rules: DataFrame,
    key: str,
    path: str = "path",
    gate: bool = False,
    indexed: bool = False,
) -> DataFrame:
    """Add ``allowed``, ``reason`` and ``min_interval_ms`` to every URL row.

    ``indexed`` meets rules by their prefixes (:func:`path_decisions`) instead of trying all patterns of
    an origin on each of its URLs: for origins with hundreds of rules and more.

    ``robots`` has (key, status, error); ``rules`` comes from :func:`robots_rules`. Both have
    one row per key, so a busy origin only skews the URL side, which AQE splits. ``gate``
    refuses unreadable files with a reason before anything else. Unknown keys count as
    failed fetches.
    """
    facts = robots.select(key, "status", "error").join(rules, key, "left")
    if indexed:
        known = path_decisions(urls, rules, key, path).select(
            F.col(key).alias("_key"), F.col(path).alias("_path"), F.struct("allowed", "reason").alias("_d")
        )
        joined = urls.join(facts.drop("allow", "disallow"), key, "left").join(
            known, (F.col(key) == F.col("_key")) & (F.col(path) == F.col("_path")), "left"
        )
    else:
        joined = urls.join(facts, key, "left")
    status, error = F.coalesce(F.col("status"), F.lit(0)), F.col("error")
    failed = error.isNotNull() | F.col("status").isNull()
    readable = ~failed & status.between(200, 399)
    missing = ~failed & (status.isin(404, 410) | (status >= 500))
    decided = joined
    if not indexed:
        decided = joined.withColumn(
            "_d", F.when(readable, decide_path(F.col(path), F.col("allow"), F.col("disallow")))
        )
    reason = F.when(missing, "no_robots").when(readable, F.col("_d.reason")).otherwise("fetch_failed")
    allowed = F.when(missing, True).when(readable, F.col("_d.allowed")).otherwise(False)
    if gate:
        unreadable = failed | (~status.between(200, 299) & ~status.isin(404, 410))
        why = F.concat(
            F.lit("robots.txt unreadable ("), F.coalesce(error, status.cast("string")), F.lit(")")
        )
        reason, allowed = F.when(unreadable, why).otherwise(reason), ~unreadable & allowed
    wait = F.when(readable, F.greatest(round_half_up(F.col("crawl_delay") * 1000.0), F.lit(0.0)))
    return decided.select(
        *urls.columns,
        allowed.alias("allowed"),
        reason.alias("reason"),
        F.coalesce(wait, F.lit(0.0)).cast("bigint").alias("min_interval_ms"),
    )
