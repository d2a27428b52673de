"""Times, game clocks, tickers and win probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: seconds of a regulation quarter and of an overtime, and the model's drift and variance
QUARTER, QUARTERS, REGULATION = 720, 4, 2880
DRIFT, VARIANCE = 3.5, 0.44


def parse_time(text: Column) -> Column:
    """Epoch seconds from seconds, milliseconds (over 1e12) or ISO-8601 text; null if it is none."""
    number = text.try_cast("double")
    iso = F.unix_micros(F.try_to_timestamp(text)) / 1e6
    return F.when(number > 1e12, number / 1000).when(number.isNotNull(), number).otherwise(iso)


def clock_seconds(period: Column, clock: Column) -> Column:
    """Seconds left to play from the period and a clock like ``PT08M09.00S``.

    Quarters after the current one count in full; overtime counts its own clock. An empty clock leaves the quarters
    after the current one in regulation, and nothing in overtime.
    """
    part = lambda n: F.regexp_extract(clock, r"^PT(\d+)M([\d.]+)S$", n)
    own = F.when(part(1) != "", part(1).cast("double") * 60 + part(2).cast("double")).otherwise(F.lit(0.0))
    return F.when(period <= QUARTERS, own + (QUARTERS - period) * QUARTER).otherwise(own)


# fixed values: Hart's coefficients of the normal distribution (1968), highest power first
UPPER_COEFFICIENTS = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER_COEFFICIENTS = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """Phi by a quotient of polynomials, and by a continued fraction beyond 7.07; right to about 1e-15."""
    z = F.abs(x)

    def polynomial(coefficients: tuple[float, ...]) -> Column:
        total = F.lit(0.0)
        for c in coefficients:
            total = total * z + c
        return total

    fraction = z + 0.65
    for k in (4, 3, 2, 1):
        fraction = z + k / fraction
    tail = F.exp(-z * z / 2) * F.when(z < 7.07, polynomial(UPPER_COEFFICIENTS) / polynomial(LOWER_COEFFICIENTS)).otherwise(1 / fraction / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def win_probability(lead: Column, seconds: Column, rate: Column | float = VARIANCE) -> Column:
    """The home side's chance with a lead and seconds left, the lead's variance growing by ``rate`` a second; decided once no time is left, even if level."""
    level = F.when(lead > 0, 1.0).when(lead < 0, 0.0).otherwise(0.5)
    return F.when(seconds <= 0, level).otherwise(normal_cdf((lead + DRIFT * seconds / REGULATION) / F.sqrt(rate * F.greatest(seconds, F.lit(1e-9)))))


def series(ticker: Column) -> Column:
    found = F.regexp_extract(ticker, r"(KXNBA\w+?)-", 1)
    return F.when(found == "", "unknown").otherwise(found)


def parse_ticker(ticker: Column) -> Column:
    """A struct of series, game_date, away, home, selection and threshold; series UNKNOWN and nulls for other forms."""
    form = r"^KXNBA(GAME|SPREAD|TOTAL|PTS)-(\d{2})([A-Z]{3})(\d{2})([A-Z]{3})([A-Z]{3})-(.+)$"
    g = lambda n: F.regexp_extract(ticker, form, n)
    known, rest, kind = g(1) != "", g(7), g(1)
    day = F.try_to_timestamp(F.concat(F.lit("20"), g(2), F.initcap(F.lower(g(3))), g(4)), F.lit("yyyyMMMdd")).cast("date")
    number = F.nullif(F.regexp_extract(rest, r"(\d+)$", 1), F.lit("")).cast("int")
    who = F.when(kind == "GAME", rest).when(kind == "SPREAD", F.regexp_replace(rest, r"\d+$", "")).when(kind == "PTS", F.regexp_extract(rest, r"^(.+)-\d+$", 1))
    return F.struct(
        F.when(known, kind).otherwise("UNKNOWN").alias("series"),
        F.when(known, day).alias("game_date"),
        F.when(known, g(5)).alias("away"),
        F.when(known, g(6)).alias("home"),
        F.when(known, who).alias("selection"),
        F.when(known & (kind != "GAME"), number).alias("threshold"),
    )


def player_parts(ticker: Column) -> Column:
    """Game, team, player and threshold of a player market; nulls if it has fewer than four parts."""
    p = F.split(ticker, "-")
    whole = F.size(p) >= 4
    at = lambda n: F.when(whole, F.get(p, F.lit(n)))
    return F.struct(at(1).alias("game"), F.substring(at(2), 1, 3).alias("team"), F.substring(at(2), 4, 99).alias("player"), at(3).try_cast("int").alias("threshold"))


def player_key(ticker: Column) -> Column:
    p = F.split(ticker, "-")
    return F.when(F.size(p) >= 4, F.get(p, F.lit(2))).otherwise(ticker)


def game_teams(game: Column) -> tuple[Column, Column]:
    """Away and home of a game key like ``26APR20MINDEN``."""
    return F.substring(game, 8, 3), F.substring(game, 11, 3)
