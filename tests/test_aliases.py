"""Proposed brand aliases: the spellings of the original run, chains, keys that very many brands share."""

import random

from basketry.operators import aliases, cleaning

# Product names of the original run, two for a brand that its rules need, with stated counts.
NAMES = [
    ("Natural Chip        Compny SeaSalt175g", 60), ("NCC Sour Cream &    Garden Chives 175g", 14), ("CCs Nacho Cheese    175g", 45),
    ("Smiths Crinkle Cut  Chips Chicken 170g", 280), ("Smith Crinkle Cut   Mac N Cheese 150g", 29), ("Kettle Tortilla ChpsHny&Jlpno Chili 150g", 410),
    ("Old El Paso Salsa   Dip Tomato Mild 300g", 93), ("Grain Waves         Sweet Chilli 210g", 62), ("GrnWves Plus Btroot & Chilli Jam 180g", 14),
    ("Doritos Corn Chip Mexican Jalapeno 150g", 240), ("Dorito Corn Chp     Supreme 380g", 31), ("Twisties Cheese     270g", 94),
    ("WW Original Stacked Chips 160g", 103), ("Woolworths Cheese   Rings 190g", 15), ("Thins Chips Light&  Tangy 175g", 140),
    ("Burger Rings 220g", 15), ("Cheezels Cheese 330g", 46), ("Infzns Crn Crnchers Tangy Gcamole 110g", 31), ("Infuzions Thai SweetChili PotatoMix 110g", 110),
    ("Red Rock Deli Sp    Salt & Truffle 150G", 58), ("RRD Steak &         Chimuchurri 150g", 118), ("Pringles Sthrn FriedChicken 134g", 250),
    ("Tyrrells Crisps     Ched & Chives 165g", 64), ("Cobs Popd Sea Salt  Chips 110g", 96), ("French Fries Potato Chips 175g", 14),
    ("Tostitos Splash Of  Lime 175g", 94), ("Cheetos Puffs 165g", 29), ("Snbts Whlgrn Crisps Cheddr&Mstrd 90g", 15), ("Sunbites Whlegrn    Crisps Frch/Onin 90g", 14),
]


def pairs(proposed):
    return {frozenset((r.alias, r.brand)): r.rules for r in proposed.collect()}


def test_the_aliases_of_the_original_run_are_proposed(spark):
    """All eight, and no other pair."""
    found = pairs(aliases.propose(spark.createDataFrame(NAMES, "PROD_NAME string, n long")))
    wanted = {frozenset(pair) for pair in cleaning.BRAND_ALIASES.items()}
    assert wanted - set(found) == set()
    assert set(found) - wanted == set()
    assert found[frozenset(("RRD", "RED"))] == "initials" and found[frozenset(("GRAIN", "GRNWVES"))] == "spelling"


def test_the_brand_has_more_lines_and_chains_end_at_the_heaviest(spark):
    rows = [("Crinklers x", 9), ("Crinkler x", 5), ("Crnklr x", 2), ("CRINKLE x", 1), ("Plain x", 50)]
    proposed = aliases.propose(spark.createDataFrame(rows, "PROD_NAME string, n long"))
    assert all(r.n_alias < r.n_brand for r in proposed.collect())
    assert sorted(map(tuple, aliases.resolved(proposed).collect())) == [("CRINKLE", "CRINKLERS"), ("CRINKLER", "CRINKLERS"), ("CRNKLR", "CRINKLERS")]


def test_a_key_that_very_many_brands_share_gives_a_link_each(spark):
    """2,000 spellings of one skeleton: as many links less one, not a million."""
    rng = random.Random(1)
    made = sorted({"".join(c + rng.choice("AEIOU") * rng.randint(0, 3) for c in "BRTKLM") for _ in range(4000)})[:2000]
    rows = [(f"{b} x", 1 + i % 7) for i, b in enumerate(made)]
    found = aliases.propose(spark.createDataFrame(rows, "PROD_NAME string, n long")).filter("rules like '%spelling%'")
    assert found.count() == len(made) - 1 and found.select("brand").distinct().count() == 1


def test_odd_names(spark):
    rows = [(None, 3), ("", 2), (" lead", 1), ("x", 1), ("7Up y", 1), ("B" * 5000 + " z", 1), ("A" * 5000, 1)]
    proposed = aliases.propose(spark.createDataFrame(rows, "PROD_NAME string, n long"))
    assert proposed.isEmpty() and aliases.resolved(proposed).isEmpty()
    assert aliases.propose(spark.createDataFrame([], "PROD_NAME string, n long")).isEmpty()
