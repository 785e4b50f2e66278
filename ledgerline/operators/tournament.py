"""Round robins played many times over: standings, scores, chances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import token
from .ratings import win_probability


def round_robin(teams: DataFrame) -> DataFrame:
    """Each pair of teams of a division once: division, one, two and their ratings."""
    a = teams.select("division", F.col("team_id").alias("one"), F.col("rating").alias("rating_one"))
    b = teams.select("division", F.col("team_id").alias("two"), F.col("rating").alias("rating_two"))
    return a.join(b, "division").where(F.col("one") < F.col("two"))


def simulate(teams: DataFrame, iterations: int, seed: str, games: int = 3) -> DataFrame:
    """A row for each match of each iteration: games won by both sides, and the winner.

    A game goes to the first team where the hash of (seed, iteration, pair, game) lies below
    its chance, so every task can play its own part and a rerun gives the same. Equal games go
    to the second team.
    """
    if iterations < 1:
        raise ValueError("one iteration at least")
    spark = teams.sparkSession
    pairs = round_robin(teams).withColumn("chance", win_probability(F.col("rating_one"), F.col("rating_two")))
    rows = pairs.crossJoin(spark.range(iterations).withColumnRenamed("id", "iteration"))
    won = [(token(seed, "iteration", "one", "two", F.lit(g)) / F.lit(2.0**52) < F.col("chance")).cast("int") for g in range(games)]
    rows = rows.withColumn("games_one", sum(won[1:], won[0])).withColumn("games_two", F.lit(games) - F.col("games_one"))
    return rows.withColumn("winner", F.when(F.col("games_one") > F.col("games_two"), F.col("one")).otherwise(F.col("two")))


def standings(matches: DataFrame, seed: str) -> DataFrame:
    """iteration, division, team_id, wins, losses, game_diff, place.

    Ties in wins: wins among the tied, then game difference, then a seeded hash, then the id.
    """
    side = lambda me, other, mine, theirs: matches.select("iteration", "division", F.col(me).alias("team_id"), F.col(other).alias("rival"), (F.col("winner") == F.col(me)).cast("int").alias("won"), (F.col(mine) - F.col(theirs)).alias("diff"))
    sides = side("one", "two", "games_one", "games_two").unionByName(side("two", "one", "games_two", "games_one"))
    key = ["iteration", "division"]
    table = sides.groupBy(*key, "team_id").agg(F.sum("won").alias("wins"), F.count_if(F.col("won") == 0).alias("losses"), F.sum("diff").alias("game_diff"))
    wins = table.select(*key, "team_id", "wins")
    tied = sides.join(wins, [*key, "team_id"]).join(wins.withColumnsRenamed({"team_id": "rival", "wins": "rival_wins"}), [*key, "rival"]).where(F.col("wins") == F.col("rival_wins"))
    among = tied.groupBy(*key, "team_id").agg(F.sum("won").alias("among"))
    rows = table.join(among, [*key, "team_id"], "left").withColumn("lot", F.sha2(F.concat_ws(":", F.lit(seed), F.col("team_id").cast("string")), 256))
    order = Window.partitionBy(*key).orderBy(F.desc("wins"), F.desc(F.coalesce("among", F.lit(0))), F.desc("game_diff"), "lot", "team_id")
    return rows.withColumn("place", F.row_number().over(order)).drop("among", "lot")


def league_table(matches: DataFrame, within: Sequence[str], seed: str) -> DataFrame:
    """within, team_id, wins, losses, games and points won and lost and their differences, place.

    ``matches``: within, one, two, winner, games_one, games_two, points_one, points_two. Ties in wins go by
    wins among the tied, game difference, point difference, a seeded hash, the id. Every match is two rows, which
    are summed by team before anything is ordered; only a group's teams are.
    """
    def side(me: str, other: str) -> DataFrame:
        named = {"games_won": f"games_{me}", "games_lost": f"games_{other}", "points_for": f"points_{me}", "points_against": f"points_{other}"}
        return matches.select(*within, F.col(me).alias("team_id"), F.col(other).alias("rival"), (F.col("winner") == F.col(me)).cast("int").alias("won"), *[F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in named.items()])

    sides = side("one", "two").unionByName(side("two", "one"))
    sums = [F.sum(c).alias(c) for c in ("games_won", "games_lost", "points_for", "points_against")]
    table = sides.groupBy(*within, "team_id").agg(F.sum("won").alias("wins"), F.count_if(F.col("won") == 0).alias("losses"), *sums)
    wins = table.select(*within, "team_id", "wins")
    tied = sides.groupBy(*within, "team_id", "rival").agg(F.sum("won").alias("won")).join(wins, [*within, "team_id"]).join(wins.withColumnsRenamed({"team_id": "rival", "wins": "rival_wins"}), [*within, "rival"])
    among = tied.where(F.col("wins") == F.col("rival_wins")).groupBy(*within, "team_id").agg(F.sum("won").alias("among"))
    rows = table.join(among, [*within, "team_id"], "left").withColumn("game_diff", F.col("games_won") - F.col("games_lost")).withColumn("point_diff", F.col("points_for") - F.col("points_against"))
    lot = F.sha2(F.concat_ws(":", F.lit(seed), F.col("team_id").cast("string")), 256)
    order = Window.partitionBy(*within).orderBy(F.desc("wins"), F.desc(F.coalesce("among", F.lit(0))), F.desc("game_diff"), F.desc("point_diff"), lot, "team_id")
    return rows.withColumn("place", F.row_number().over(order)).drop("among")


#: Points for a title, a second place, a place among four, and a match won.
CHAMPION, RUNNER_UP, TOP_FOUR, MATCH_WIN = 10.0, 6.0, 3.0, 1.0


def credits(places: DataFrame, picks: DataFrame, top_four: bool = True) -> DataFrame:
    """group_id, score, champions, runners_up, top_four, match_wins: over all tables that a group's teams are in.

    ``picks`` has group_id, team_id; a team picked twice by a group counts once.
    """
    at = lambda n: F.col("place") == n
    points = F.col("wins") * MATCH_WIN + F.when(at(1), CHAMPION).when(at(2), RUNNER_UP).otherwise(0.0) + (F.when(F.col("place") <= 4, TOP_FOUR).otherwise(0.0) if top_four else F.lit(0.0))
    both = places.join(picks.select("group_id", "team_id").distinct(), "team_id")
    return both.groupBy("group_id").agg(F.sum(points).alias("score"), F.count_if(at(1)).alias("champions"), F.count_if(at(2)).alias("runners_up"), F.count_if(F.col("place") <= 4).alias("top_four"), F.sum("wins").alias("match_wins"))


def chances(places: DataFrame, iterations: int) -> DataFrame:
    """Shares of titles and top-three places, mean place and share of matches won, by team."""
    share = lambda c: F.round(F.count_if(c) / F.lit(float(iterations)), 4)
    won = F.sum("wins").cast("double")
    return places.groupBy("division", "team_id").agg(share(F.col("place") == 1).alias("title_share"), share(F.col("place") <= 3).alias("top_three_share"), F.round(F.avg("place"), 4).alias("mean_place"), F.round(won / (won + F.sum("losses")), 4).alias("win_share"))


def group_scores(places: DataFrame, picks: DataFrame, match_win: float = 1.0, champion: float = 10.0, runner_up: float = 6.0, top_four: float = 3.0) -> DataFrame:
    """Points of each group for the teams it picked: ``picks`` has group_id, team_id."""
    points: Column = F.col("wins") * match_win + F.when(F.col("place") == 1, champion).when(F.col("place") == 2, runner_up).otherwise(0.0) + F.when(F.col("place") <= 4, top_four).otherwise(0.0)
    return places.join(picks.distinct(), "team_id").groupBy("iteration", "group_id").agg(F.sum(points).alias("score"), F.count_if(F.col("place") == 1).alias("champions"), F.sum("wins").alias("match_wins"))


#: What an earlier match together adds, by class of match.
TOGETHER = {"casual": 0.05, "semi_competitive": 0.10, "competitive": 0.18}


def pair_weight(match_class: str, band: float, target_rating: float | None = None, target_region: int | None = None) -> Column:
    """How well two players go together for one match.

    From columns first_rating, second_rating, first_region, second_region, shared_club, prior_count,
    first_load, second_load: near ratings, one region, a common club, nearness to what is asked for and earlier
    matches together count for a pair, recent matches against it.
    """
    near = lambda gap: F.greatest(F.lit(0.05), 1 - gap / F.lit(float(band or 1)))
    rating = near(F.abs(F.col("first_rating") - F.col("second_rating")))
    place = F.when(F.col("first_region").eqNullSafe(F.col("second_region")), 1.0).otherwise(0.25)
    if target_region is not None:
        place = place + F.when((F.col("first_region") == target_region) | (F.col("second_region") == target_region), 0.75).otherwise(0.0)
    wanted = near(F.abs((F.col("first_rating") + F.col("second_rating")) / 2 - target_rating)) if target_rating is not None else F.lit(0.0)
    before = F.least(F.coalesce("prior_count", F.lit(0)) * F.lit(TOGETHER.get(match_class, 0.05)), F.lit(1.0))
    return F.greatest(F.lit(0.01), 1 + rating + place + F.when(F.col("shared_club"), 0.5).otherwise(0.0) + wanted + before - (F.col("first_load") + F.col("second_load")) * 0.05)


def submission_issues(picks: DataFrame, teams: DataFrame, active: DataFrame, members: DataFrame, rated: DataFrame, run: int) -> DataFrame:
    """group_id, team_id, country_code, division, field, code: what speaks against each pick.

    ``picks``: group_id, team_id, country_code, division. ``teams``: team_id, generation_run_id,
    country_code, team_division. ``active``: team_id, is_active. ``members``: team_id, player_id and
    the player's country_code, of the rosters of the day. ``rated``: player_id. An unknown team has no further issue;
    a roster of other than two is not looked into.
    """
    known = rated.select("player_id", F.lit(1).alias("has_rating")).distinct()
    rosters = members.withColumnRenamed("country_code", "from_country").join(known, "player_id", "left").groupBy("team_id").agg(F.count("*").alias("size"), F.min("from_country").alias("one"), F.max("from_country").alias("two"), F.count_if(F.col("from_country").isNull()).alias("nowhere"), F.count("has_rating").alias("with_rating"))
    team = teams.select("team_id", F.col("generation_run_id").alias("run"), F.col("country_code").alias("home"), "team_division", F.lit(True).alias("found"))
    rows = picks.join(team, "team_id", "left").join(active.select("team_id", "is_active"), "team_id", "left").join(rosters, "team_id", "left")
    here, pair = F.col("found").isNotNull(), F.coalesce("size", F.lit(0)) == 2
    abroad = ~(F.col("one").eqNullSafe(F.col("home")) & F.col("two").eqNullSafe(F.col("home")) & (F.col("nowhere") == 0))
    tests = (
        ("team_id", "team_not_found", ~here),
        ("team_id", "wrong_generation_run", here & ~F.col("run").eqNullSafe(F.lit(run))),
        ("country_code", "country_mismatch", here & ~F.col("home").eqNullSafe(F.col("country_code"))),
        ("division", "division_mismatch", here & ~F.col("team_division").eqNullSafe(F.col("division"))),
        ("team_id", "team_not_active", here & ~F.coalesce("is_active", F.lit(False))),
        ("team_id", "invalid_roster", here & ~pair),
        ("team_id", "cross_country_team", here & pair & abroad),
        ("team_id", "missing_rating", here & pair & (F.col("with_rating") < 2)),
    )
    issues = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))) for field, code, bad in tests]))
    return rows.select("group_id", "team_id", "country_code", "division", F.explode(issues).alias("issue")).select("group_id", "team_id", "country_code", "division", "issue.*")
