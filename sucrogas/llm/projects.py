"""Which authorised plant a project row is about."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sucrogas.functions import cnpj
from sucrogas.functions.names import tokens
from sucrogas.llm.match import best_match, one_to_one, score_pairs, sorted_neighbourhood
from sucrogas.llm.places import PlaceIndex, places_of, state_of
from sucrogas.llm.titles import Places, gazetteer
from sucrogas.operators.snapshots import latest
from sucrogas.operators.units import capacities_in_common_units
from sucrogas.session import ensure_checkpoint_dir

#: Least confidence of a match.
MIN_CONFIDENCE = 0.72


def project_records(projects: DataFrame, classes: DataFrame, places: Places, index: PlaceIndex) -> DataFrame:
    """One row per project, company named in its title and place named in its location (else title).

    Returns ``id``, ``company``, ``place`` (NULL if none), ``uf`` (the column, else the location's state code).  Copies of a
    row are one record.  Titles that name no company give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, title, loc, uf in zip(b["id"], b.project, b.location, b.uf, strict=True):
                if not isinstance(title, str):
                    continue
                loc = loc if isinstance(loc, str) else None
                found = places_of(loc, index) or [" ".join(p) for p in places.cut(tokens(title))[1]] or [None]
                state = uf if isinstance(uf, str) else state_of(loc)
                out += [(i, title, p, state) for p in found]
            yield pd.DataFrame(out, columns=["id", "project", "place", "uf"])

    rows = projects.select("id", "project", "location", "uf").where(F.col("id").isNotNull()).distinct().mapInPandas(run, "id long, project string, place string, uf string")
    return rows.join(classes.select(F.col("name").alias("project"), F.col("class").alias("company")), "project").select("id", "company", "place", "uf").distinct()


def plant_records(snapshots: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per plant, company, place and state: ``cnpj``, ``company``, ``place``, ``uf`` and the capacities it has had."""
    keyed = snapshots.select(cnpj.normalize(F.col("cnpj")).alias("cnpj"), "snapshot_date", "razao_social", "municipio", "uf", "cap_biometano_m3d", "delivered_at")
    valid = latest(keyed, ["snapshot_date", "cnpj"], "delivered_at", ["razao_social", "municipio", "uf", "cap_biometano_m3d"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["place"] = [" ".join(tokens(x)) if isinstance(x, str) else None for x in b.municipio]
            yield b[["cnpj", "razao_social", "place", "uf", "caps"]]

    # At most one capacity per snapshot and plant, so the array is bounded by the number of snapshots.
    few = valid.groupBy("cnpj", "razao_social", "municipio", "uf").agg(F.collect_set(F.round("cap_biometano_m3d", 1)).alias("caps"))
    rows = few.mapInPandas(run, "cnpj string, razao_social string, place string, uf string, caps array<double>")
    named = rows.join(classes.select(F.col("name").alias("razao_social"), F.col("class").alias("company")), "razao_social")
    return named.groupBy("cnpj", "company", "place", "uf").agg(F.array_distinct(F.flatten(F.collect_list("caps"))).alias("caps"))


def match_projects(projects: DataFrame, snapshots: DataFrame, classes: DataFrame, municipalities: DataFrame) -> DataFrame:
    """The plant of each project row with a confidence: ``id``, ``cnpj``, ``confidence``.

    ``classes`` are the name classes of all titles and company names (``name``, ``class``).
    Candidates come from the sorted neighbourhood over three composite keys (company and place,
    place and company, company and state and capacity); each gets weighted similarities of name,
    place, state and capacity.  Rows that name one company at one place are about one thing, and things and plants are assigned one
    to one with the highest total confidence; each row follows its thing.  A match needs the company and the place, or where no place is
    stated an equal capacity in the same state.
    """
    ensure_checkpoint_dir(projects.sparkSession)
    places = gazetteer(municipalities, "municipio")
    index = PlaceIndex([" ".join(n) for many in places.first.values() for n in many])
    caps = capacities_in_common_units(projects, "id", "capacity_value", "capacity_unit", ["capacity_basis", "notes"]).where("quantity = 'gas flow'")
    caps = caps.groupBy(F.col("record_id").cast("long").alias("id")).agg(F.max("value").alias("cap"))
    left = project_records(projects, classes, places, index).join(caps, "id", "left")
    # Rows that say the same about company, place, state and capacity are compared once.
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = left.withColumn("lid", F.concat_ws("\x01", "company", blank("place"), blank("uf"), blank("cap"))).checkpoint()
    left = said.select("lid", "company", "place", "uf", "cap").distinct()
    right = plant_records(snapshots, classes).withColumn("rid", F.concat_ws("\x01", "cnpj", "company", blank("place"), blank("uf"))).checkpoint()
    level = lambda c: F.lpad(F.floor(F.log(c) * 20).cast("string"), 4, "0")
    text = lambda *cs: F.concat_ws("|", *cs)
    # A plant stands in the order at every capacity it has had, so a row that states an earlier one finds it.
    at = lambda c: text("company", F.coalesce("uf", F.lit("")), level(c))
    had = F.filter("caps", lambda c: c > 0)
    every = F.explode(F.when(F.size(had) > 0, F.transform(had, at)).otherwise(F.array(text("company", F.coalesce("uf", F.lit(""))))))
    passes = [
        ("company and place", text("company", "place"), text("company", "place")),
        ("place and company", F.when(F.col("place").isNotNull(), text("place", "company")), text("place", "company")),
        ("company, state, capacity", text("company", F.coalesce("uf", F.lit("")), F.coalesce(level(F.col("cap")), F.lit(""))), every),
    ]
    pairs = sorted_neighbourhood(left, right, "lid", "rid", passes)
    a = left.select("lid", *[F.col(c).alias(f"{c}_a") for c in ("company", "place", "uf", "cap")])
    b = right.select("rid", "cnpj", *[F.col(c).alias(f"{c}_b") for c in ("company", "place", "uf", "caps")])
    scored = score_pairs(pairs.join(a, "lid").join(b, "rid"))
    placed = F.coalesce(F.col("s_place") == 1, F.lit(False))
    unplaced = F.col("place_a").isNull() & (F.coalesce(F.col("s_capacity"), F.lit(0.0)) > 0.99) & F.coalesce(F.col("s_state") == 1, F.lit(False))
    state = F.coalesce(F.col("s_state") == 1, F.lit(True))
    good = scored.where((F.col("s_name") == 1) & state & (placed | unplaced) & (F.col("confidence") >= MIN_CONFIDENCE))
    # What the rows of one company say about one place is one thing; things and plants are assigned one to one.  Statements that leave out the
    # place or the state may be about the same plant as fuller ones, so each kind of statement is assigned by itself.
    whole, kind = F.col("place_a").isNotNull(), F.concat(F.col("place_a").isNotNull().cast("string"), F.col("uf_a").isNotNull().cast("string"))
    block = F.concat_ws("\x01", "company_a", blank("place_a"), blank("uf_a"), kind)
    things = good.select("lid", "cnpj", "confidence", block.alias("block"), F.when(whole, block).otherwise(F.col("lid")).alias("thing")).checkpoint()
    assigned = one_to_one(things, "thing", "cnpj", "block").select("thing", "cnpj")
    per_statement = things.join(assigned, ["thing", "cnpj"]).select("lid", "cnpj", "confidence")
    return best_match(said.select("id", "lid").join(per_statement, "lid"), "id", "cnpj")
