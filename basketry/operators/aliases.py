"""Brand spellings that may stand for the same brand, proposed by keys that both spellings share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import first_word_upper
from basketry.session import stage

#: Letters a spelling must share after its vowels are gone, and letters that a truncated one must keep.
LEAST = 4
#: Letters of the longest brand whose short forms are listed.
LONGEST = 30


def skeleton(word: Column) -> Column:
    """The word without vowels, but for its first letter."""
    return F.concat(F.substring(word, 1, 1), F.regexp_replace(F.substr(word, F.lit(2)), "[AEIOU]", ""))


def _letters(brand: Column) -> Column:
    """First letter and one or two later ones, in order."""
    at = lambda i: F.substr(brand, i, F.lit(1))
    size, first = F.length(brand), F.substring(brand, 1, 1)
    pairs = F.transform(F.sequence(F.lit(2), size), lambda i: F.concat(first, at(i)))
    triples = F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda i: F.transform(F.sequence(i + 1, size), lambda j: F.concat(first, at(i), at(j))),
    )
    return F.array_distinct(F.concat(pairs, F.flatten(triples)))


def _short_forms(products: DataFrame, brands: DataFrame) -> DataFrame:
    """rule, key, BRAND: what a brand may be shortened to."""
    whole = F.col("BRAND").rlike(f"^[A-Z]{{{LEAST},{LONGEST}}}$")
    size = F.length("BRAND")
    cut = F.array(*[F.expr(f"left(BRAND, length(BRAND) - {k})") for k in (1, 2)])
    kept = F.filter(cut, lambda c: F.length(c) >= LEAST)
    firsts = F.transform("words", lambda w: F.substring(w, 1, 1))
    initials = F.transform(
        F.filter(F.array(*[F.lit(k) for k in (3, 4, 5)]), lambda k: k <= F.size("words")),
        lambda k: F.array_join(F.slice(firsts, F.lit(1), k), ""),
    )
    return (
        brands.filter(whole).select(F.lit("letters").alias("rule"), F.explode(_letters(F.col("BRAND"))).alias("key"), "BRAND")
        .union(brands.filter(size > LEAST).select(F.lit("truncated"), F.explode(kept), "BRAND"))
        .union(products.select(F.lit("initials"), F.explode(initials), "BRAND"))
        .filter("key <> BRAND")
        .distinct()
    )


def propose(products: DataFrame, weight: str = "n") -> DataFrame:
    """Pairs of spellings (alias, brand) that may be one brand, with the rules that propose them.

    ``products`` has PROD_NAME and ``weight``, its lines. A spelling is the first word of a name. Rules:

    * ``initials``: it is made of the first letters of the first three to five words of a product of the other one.
    * ``letters``: it has two or three letters, none but the first a vowel, and the other one has them in this order.
    * ``truncated``: the other one has one or two letters more behind it.
    * ``spelling``: both are the same without vowels (four letters at least), where the first two words of a name
      also count as one word.

    Every rule is a key that both sides share: nothing compares pairs, and a key that very many brands share
    proposes only its heaviest one, found by a maximum that is combined in the tasks. Of a pair the one with more lines is
    the brand (ties: the longer, then the greater). Names that are missing, or without a first word, propose nothing.
    """
    named = products.select(
        first_word_upper(F.col("PROD_NAME")).alias("BRAND"),
        F.regexp_extract_all(F.upper("PROD_NAME"), F.lit("[A-Z]+"), F.lit(0)).alias("words"),
        F.col(weight).cast("long").alias("n"),
    ).filter("BRAND <> ''")
    products = stage(named.groupBy("BRAND", F.slice("words", 1, 5).alias("words")).agg(F.sum("n").alias("n")))
    brands = stage(products.groupBy("BRAND").agg(F.sum("n").alias("n")))
    heaviest = F.max(F.struct("n", F.length("BRAND").alias("size"), "BRAND")).alias("head")

    short = _short_forms(products, brands).join(brands, "BRAND").groupBy("rule", "key").agg(heaviest)
    bare = (F.col("rule") != "letters") | (F.length("BRAND").between(2, 3) & (skeleton(F.col("BRAND")) == F.col("BRAND")))
    shortened = brands.join(short, F.col("BRAND") == F.col("key")).filter(bare)

    joined = products.filter(F.size("words") > 1).select("BRAND", skeleton(F.concat(F.col("words")[0], F.col("words")[1])).alias("key"))
    spelt = (
        brands.filter(F.col("BRAND").rlike("^[A-Z]+$")).select("BRAND", skeleton(F.col("BRAND")).alias("key"))
        .union(joined).filter(F.length("key") >= LEAST).distinct().join(brands, "BRAND")
    )
    heads = spelt.groupBy("key").agg(heaviest, F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    respelt = spelt.join(heads, "key").withColumn("rule", F.lit("spelling"))

    links = shortened.select("rule", "BRAND", "n", "head").union(respelt.select("rule", "BRAND", "n", "head"))
    one = F.struct("n", F.length("BRAND").alias("size"), "BRAND")
    pairs = links.filter("BRAND <> head.BRAND").select("rule", F.least(one, F.col("head")).alias("a"), F.greatest(one, F.col("head")).alias("b"))
    return pairs.groupBy(
        F.col("a.BRAND").alias("alias"), F.col("b.BRAND").alias("brand"), F.col("a.n").alias("n_alias"), F.col("b.n").alias("n_brand")
    ).agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))


def resolved(proposed: DataFrame) -> DataFrame:
    """alias, brand: every alias with the brand at the end of its chain of proposals.

    An alias goes to the heaviest brand proposed for it. Links lead to heavier spellings only, so chains end;
    their length halves in each round, which joins the staged links to themselves.
    """
    best = F.max(F.struct("n_brand", F.length("brand"), "brand")).alias("best")
    links = stage(proposed.groupBy("alias").agg(best).select("alias", F.col("best.brand").alias("brand")))
    while True:
        further = links.select(F.col("alias").alias("_via"), F.col("brand").alias("_end"))
        moved = links.join(further, F.col("brand") == F.col("_via"), "left")
        links = stage(moved.select("alias", F.coalesce("_end", "brand").alias("brand"), F.col("_end").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            return links.select("alias", "brand")
        links = links.select("alias", "brand")
