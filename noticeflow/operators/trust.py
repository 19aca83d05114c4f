"""Trust verdicts by rules held in a table, for lists too long to be stated in an expression."""

from pyspark.sql import functions as F

#: Up to this many rules are part of the expression (`functions.trust`); more are looked up.
MOST_LITERAL = 64
#: An ending that more domains than this share is looked up in several parts of about as many.
PART_ROWS = 1 << 18
#: The most frequent endings that are looked at for this, and how many the sketch of a task holds.
COMMON, TRACKED = 256, 1024


def rule_keys(domain, suffix_lengths):
    """array<struct<kind, value>>: the rules a domain may be trusted by.

    A `domain` rule names the domain or what follows one of its dots; a `suffix` rule is the end of
    the domain, of any of the lengths that suffix rules have.
    """
    labels = F.sequence(F.lit(1), F.size(F.split(domain, r"\.", -1)))
    known = F.transform(labels, lambda n: F.struct(F.lit("domain").alias("kind"), F.call_function("substring_index", domain, F.lit("."), -n).alias("value")))
    ends = [
        F.when(F.length(domain) >= n, F.struct(F.lit("suffix").alias("kind"), F.substring(domain, F.length(domain) - n + 1, F.lit(n)).alias("value")))
        for n in suffix_lengths
    ]
    return F.concat(known, F.array_compact(F.array(*ends))) if ends else known


def spread(keys, rules):
    """`keys` (`domain`, `kind`, `value`) and `rules` (`kind`, `value`) with a column `part`, so that no value has too many keys in a part.

    The counts come from a sketch of bounded size that misses no value with over 1/200 of the keys.  They decide
    how many parts a value has, not what is found: a rule stands in every part of its value.
    """
    counts = keys.agg(F.expr(f"approx_top_k(value, {COMMON}, {TRACKED})").alias("top")).select(F.explode("top").alias("top"))
    parts = counts.select(F.col("top.item").alias("value"), (F.floor(F.col("top.count") / PART_ROWS) + 1).alias("parts")).filter("parts > 1")

    def own(df):
        return df.join(F.broadcast(parts), "value", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    dealt = own(keys).select("domain", "kind", "value", F.pmod(F.xxhash64("domain"), F.col("parts")).alias("part"))
    return dealt, own(rules).select("kind", "value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def trusted_domains(domains, rules):
    """The values of the column `domain` that a rule (`kind`, `value`) trusts, each once; null is trusted by none.

    The cost follows the number of distinct domains and their labels: each is looked up by hash, whatever
    the number of rules.  An ending that very many domains share is looked up in parts.
    """
    rules = rules.select("kind", "value").dropna().distinct()
    lengths = [r[0] for r in rules.filter("kind = 'suffix'").select(F.length("value")).distinct().collect()]
    # Filtered as a join on the result would filter, so that both uses of the keys read one shuffle.
    asked = domains.select("domain").filter("domain is not null").distinct()
    keys = asked.select("domain", F.explode(rule_keys(F.col("domain"), sorted(lengths))).alias("k")).select("domain", "k.*")
    keys, rules = spread(keys, rules)
    return keys.join(rules, ["kind", "value", "part"], "left_semi").select("domain").distinct()


def with_verdict(records, rules, domain="official_domain", name="source_verified"):
    """`records` with a verdict by rules in a table; a domain that very many records share is left to the skew split."""
    found = trusted_domains(records.select(F.col(domain).alias("domain")), rules)
    found = found.select(F.col("domain").alias("_domain"), F.lit(True).alias("_trusted"))
    joined = records.join(found, records[domain] == found["_domain"], "left")
    return joined.withColumn(name, F.coalesce("_trusted", F.lit(False))).drop("_domain", "_trusted")
