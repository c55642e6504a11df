"""States by postal code, census code and name, and the words for their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Postal code, census code and name.
STATES = [
    ("AL", "01", "Alabama"), ("AK", "02", "Alaska"), ("AZ", "04", "Arizona"), ("AR", "05", "Arkansas"), ("CA", "06", "California"), ("CO", "08", "Colorado"), ("CT", "09", "Connecticut"),
    ("DE", "10", "Delaware"), ("DC", "11", "District of Columbia"), ("FL", "12", "Florida"), ("GA", "13", "Georgia"), ("HI", "15", "Hawaii"), ("ID", "16", "Idaho"), ("IL", "17", "Illinois"),
    ("IN", "18", "Indiana"), ("IA", "19", "Iowa"), ("KS", "20", "Kansas"), ("KY", "21", "Kentucky"), ("LA", "22", "Louisiana"), ("ME", "23", "Maine"), ("MD", "24", "Maryland"),
    ("MA", "25", "Massachusetts"), ("MI", "26", "Michigan"), ("MN", "27", "Minnesota"), ("MS", "28", "Mississippi"), ("MO", "29", "Missouri"), ("MT", "30", "Montana"), ("NE", "31", "Nebraska"),
    ("NV", "32", "Nevada"), ("NH", "33", "New Hampshire"), ("NJ", "34", "New Jersey"), ("NM", "35", "New Mexico"), ("NY", "36", "New York"), ("NC", "37", "North Carolina"), ("ND", "38", "North Dakota"),
    ("OH", "39", "Ohio"), ("OK", "40", "Oklahoma"), ("OR", "41", "Oregon"), ("PA", "42", "Pennsylvania"), ("RI", "44", "Rhode Island"), ("SC", "45", "South Carolina"), ("SD", "46", "South Dakota"),
    ("TN", "47", "Tennessee"), ("TX", "48", "Texas"), ("UT", "49", "Utah"), ("VT", "50", "Vermont"), ("VA", "51", "Virginia"), ("WA", "53", "Washington"), ("WV", "54", "West Virginia"),
    ("WI", "55", "Wisconsin"), ("WY", "56", "Wyoming"),
]
# Words for a county where it is not called so.
TERMS = {"LA": ("parish", "parishes"), "AK": ("borough", "boroughs")}


def _looked_up(key: Column, pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[key]


def census_code(postal: Column) -> Column:
    """Null for an unknown code."""
    return _looked_up(postal, [(p, c) for p, c, _ in STATES])


def postal_code(census: Column) -> Column:
    return _looked_up(census, [(c, p) for p, c, _ in STATES])


def state_name(postal: Column) -> Column:
    return _looked_up(postal, [(p, n) for p, _, n in STATES])


def county_term(postal: Column, plural: bool = False) -> Column:
    return F.coalesce(_looked_up(postal, [(p, t[plural]) for p, t in TERMS.items()]), F.lit("counties" if plural else "county"))


def county_context(units: DataFrame, counties: DataFrame) -> DataFrame:
    """geoid and context: the county's name, else its five digits, else the code itself if shorter; counties: county, name."""
    u = units.select("geoid", F.substring("geoid", 1, 5).alias("county"))
    return u.join(counties.select("county", "name"), "county", "left").select("geoid", F.when(F.length("geoid") < 5, F.col("geoid")).otherwise(F.coalesce("name", "county")).alias("context"))
