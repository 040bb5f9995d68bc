"""What is learned about an organisation from addresses: its domains, its qualifiers of names, and mailboxes of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fold

# Subdomains that name no organisation, and thresholds.
PLAIN = ["mail", "smtp", "email", "mx", "www", "m"]
HOME_SHARED, HOME_OVERLAP, FUNCTION_ORGS, QUALIFIER_PARTNERS = 3, 0.25, 3, 8


def domain_label(address: Column) -> Column:
    """The leftmost label of an address's domain that isn't a plain subdomain."""
    labels = F.split(F.lower(F.substring_index(address, "@", -1)), r"\.")
    return F.coalesce(F.get(F.filter(labels, lambda x: ~x.isin(["", *PLAIN])), F.lit(0)), F.lower(F.substring_index(address, "@", -1)))


def mailboxes(addresses: DataFrame) -> DataFrame:
    return addresses.select(domain_label(F.col("email")).alias("label"), F.substring_index(F.lower("email"), "@", 1).alias("local"))


def home_labels(addresses: DataFrame) -> DataFrame:
    """The label with most mailboxes, and those that share enough distinctive mailboxes (at two labels at most) with it."""
    own = mailboxes(addresses).distinct()
    sizes = own.groupBy("label").agg(F.count("*").alias("n"))
    home = sizes.orderBy(F.desc("n"), "label").limit(1)
    rare = own.join(own.groupBy("local").agg(F.count("*").alias("labels")).where("labels <= 2"), "local", "left_semi")
    of_home = rare.join(F.broadcast(home), "label", "left_semi").select("local")
    shared = rare.join(F.broadcast(home), "label", "left_anti").join(of_home, "local", "left_semi").groupBy("label").agg(F.count("*").alias("shared"))
    both = shared.join(rare.groupBy("label").agg(F.count("*").alias("own")), "label")
    near = both.where((F.col("shared") >= HOME_SHARED) & (F.col("shared") / F.least(F.col("own"), F.lit(of_home.count())) >= HOME_OVERLAP))
    return home.select("label").union(near.select("label"))


def functional(addresses: DataFrame, people: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """Mailboxes at FUNCTION_ORGS organisations or more, unless all their tokens name someone.

    A token names someone if it is one of ``people`` (token), or such a one behind an initial. Labels in ``home`` are one organisation.
    """
    own = mailboxes(addresses).distinct()
    if home is not None:
        own = own.join(home.select("label").distinct().withColumn("h", F.lit(True)), "label", "left").select("local", F.when(F.col("h"), "").otherwise(F.col("label")).alias("label"))
    often = own.groupBy("local").agg(F.count_distinct("label").alias("labels")).where(F.col("labels") >= FUNCTION_ORGS)
    parts = often.select("local", "labels", F.explode(F.filter(F.split("local", r"[^\p{L}]+"), lambda t: t != "")).alias("token"))
    known = people.select("token").distinct().withColumn("known", F.lit(1))
    behind = known.select(F.col("token").alias("rest"), F.col("known").alias("behind"))
    rest = F.when(F.length("token") > 2, F.substring(F.col("token"), F.lit(2), F.length("token")))
    named = parts.withColumn("rest", rest).join(known, "token", "left").join(behind, "rest", "left")
    named = named.groupBy("local").agg(F.count("*").alias("tokens"), F.count(F.coalesce("known", "behind")).alias("known"))
    return often.join(named, "local", "left").where("known IS NULL OR known < tokens").select("local", "labels")


def qualifiers(names: DataFrame, addresses: DataFrame) -> DataFrame:
    """Words that follow many different words in names and hardly occur in mailboxes, with or without their marks."""
    t = F.split(F.lower("name"), " ")
    pairs = names.select(F.explode(F.arrays_zip(F.slice(t, 1, F.size(t) - 1).alias("before"), F.slice(t, 2, F.size(t)).alias("token"))).alias("p")).select("p.before", "p.token").where("before IS NOT NULL AND token IS NOT NULL")
    many = pairs.groupBy("token").agg(F.count_distinct("before").alias("partners")).where(F.col("partners") >= QUALIFIER_PARTNERS)
    boxes = mailboxes(addresses).select(F.explode(F.split("local", r"[^\p{L}]+")).alias("form")).groupBy("form").agg(F.count("*").alias("boxes"))
    folded = fold(F.col("token"))
    forms = many.select("token", "partners", F.explode(F.array_distinct(F.array("token", folded, F.replace(folded, F.lit("u"), F.lit("ue"))))).alias("form"))
    best = forms.join(boxes, "form", "left").groupBy("token", "partners").agg(F.coalesce(F.max("boxes"), F.lit(0)).alias("boxes"))
    return best.where(4 * F.col("boxes") < F.col("partners")).select("token", "partners")


def learn(addresses: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(home labels, qualifiers, functional mailboxes) of address and name occurrences (email) and (name)."""
    home, titles = home_labels(addresses), qualifiers(names, addresses)
    tokens = names.select(F.explode(F.split(F.lower("name"), " ")).alias("token")).where("token <> ''").distinct()
    return home, titles, functional(addresses, tokens.join(titles, "token", "left_anti"), home)


def org_of(addresses: DataFrame, home: DataFrame) -> DataFrame:
    """(email, org): the organisation of each address's domain; those at home are one, ''."""
    own = addresses.select("email", domain_label(F.col("email")).alias("label"))
    return own.join(home.select("label").distinct().withColumn("h", F.lit(True)), "label", "left").select("email", F.when(F.col("h"), "").otherwise(F.col("label")).alias("org"))
