"""Parameters that play, on the given tables, the part of the original run's fixed values."""

import datetime as dt

from basketry.operators.stores import TrialDesign
from basketry.sources.tpch import Gaps

EXCLUDED = "gizmo"
OUTLIER_QTY = 50
OUTLIER_CARD = 12
OUTLIER_FACTOR = 100  # the outlier card's units are so many times as large where it is to be found
BRAND_ALIASES = {"OLD": "NEW", "HOT": "COLD"}
PACK_SIZE = 27
# Names with such pack sizes spell their first word without vowels, or without its last letter.
BARE_PACKS, CUT_PACKS = 5, 7
LIFESTAGE = "BUILDING"
TTEST_LIFESTAGES = ("BUILDING", "MACHINERY")
PREMIUM = "Mainstream"
DECEMBER = 12

# The stated range of the calendar: all days of the years and months that the tables span.
FIRST_DAY = dt.date(1995, 1, 1)
LAST_DAY = dt.date(2001, 8, 31)

# The tables hold no missing value and no unknown card; the checks for both need some.
GAPS = Gaps(card=89, unknown=31, name=97)

# The tables span 1995-01 to 2001-08; August 2001 has a single day and does not count as an
# observed month. The stores 5, 6 and 8 are fully observed at every scale.
DESIGN = TrialDesign(
    trials=(5, 6, 8),
    pre_end=200102,
    trial_start=200102,
    trial_end=200104,
    trend_end=200103,
    n_months=79,
    observed_until=200108,
    df=72,
)

# As-written variants of the original run concern its second trial store.
SECOND_TRIAL = DESIGN.trials[1]
FIRST_TRIAL = DESIGN.trials[0]

# A month that is delivered again, then without the lines of fewer units.
RESTATED_MONTH = 199912
RESTATED_QTY = 10

# The year whose months are summed up from their sketches.
YEAR_MONTHS = tuple(199901 + m for m in range(12))
