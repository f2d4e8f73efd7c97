"""Queries over the whole `events` table, one per operator.

Each takes (spark, folder of parquet tables) and returns a frame of plain columns: maps and structs
are shown as JSON text, and sums and means are rounded so that the order of additions cannot show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions import comments, effects, payload, text, vectors
from runlens.models import offers as O
from runlens.models import outcome as M
from runlens.operators import adaptation as A
from runlens.operators import features as E
from runlens.operators import snapshots as S
from runlens.operators import training as R
from runlens.operators.runs import ORDER, large_keys, newest, union_all
from runlens.schemas import AUDIT, ENVELOPE, FLAT_EVENT, NUMERIC_FEATURES
from runlens.session import scratch_dir, shuffled_into, stage, state_partitions, state_parts
from runlens.sinks import cache
from runlens.sinks import tables as sinks
from runlens.sinks.topics import to_messages
from runlens.sources import events as X
from runlens.sources import tables as sources
from runlens.sources.telemetry import gameplay_events, gameplay_records
from runlens.streaming import asof, ingest, replay
from runlens.streaming import profile as P
from runlens.streaming.jobs import audit_counts, run_bootstrap, start_asof_enrichment

Query = Callable[[SparkSession, str], DataFrame]

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
STALE_MS = 6 * HOUR_MS
FEW_RUNS = 4
SLICES = 10
REGISTRY: dict[str, Query] = {}


def query(work: Query) -> Query:
    REGISTRY[work.__name__] = work
    return work


def on_events(work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query that needs the flat gameplay events only."""
    REGISTRY[work.__name__] = lambda spark, sf_dir: work(gameplay_events(spark, sf_dir))
    return work


def shown(rows: DataFrame, **digits: int) -> DataFrame:
    """Maps as JSON text, fractions rounded to 9 digits or as given."""
    columns: list[Column] = []
    for name, kind in rows.dtypes:
        if kind.startswith("map"):
            columns.append(F.to_json(name).alias(name))
        elif kind == "double":
            columns.append(F.round(name, digits.get(name, 9)).alias(name))
        else:
            columns.append(F.col(name))
    return rows.select(*columns)


def stored_records(events: DataFrame) -> DataFrame:
    """Training records as a written table, for work that reads them more than once."""
    return stage(R.training_records(events), "records")


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


# --- sources -------------------------------------------------------------------------------------

@query
def decoded_events(spark, sf_dir):
    return X.decode_events(gameplay_records(spark, sf_dir), keep=("event_id",)).drop("payload")


@query
def valid_and_quarantined(spark, sf_dir):
    good, bad = X.split_valid(_broken(gameplay_records(spark, sf_dir)), ("event_id",))
    return union_all(good.select("event_id", F.lit("valid").alias("status")),
                     bad.select("event_id", F.lit("quarantined").alias("status")))


@query
def payload_fields(spark, sf_dir):
    events = X.decode_events(gameplay_records(spark, sf_dir), keep=("event_id",))
    at = F.col("payload")
    return events.select(
        "event_id", payload.payload_field(at, "dir.dx", "double").alias("move_dx"),
        payload.payload_field(at, "direction.dy", "double").alias("dash_dy"),
        payload.payload_field(at, "velocity.vx", "double").alias("kill_vx"),
        payload.payload_field(at, "boss_archetype").alias("boss_archetype"))


@query
def safe_fields(spark, sf_dir):
    """Defaults of missing fields, after the round trip through JSON."""
    good, _ = X.split_valid(gameplay_records(spark, sf_dir), ("event_id",))
    flat = X.flatten_payload(good)
    kind = F.col("event_type")
    return flat.select(
        "event_id", "x", "y",
        F.when(kind.isin(C.DAMAGE_DEALT, C.DAMAGE_TAKEN), F.col("dmg_amount")).alias("dmg_amount"),
        F.when(kind == C.DAMAGE_TAKEN, F.col("is_elite_source")).alias("is_elite_source"),
        F.when(kind == C.STATUS, F.col("hp")).alias("hp"),
        F.when(kind == C.STATUS, F.col("max_hp")).alias("max_hp"),
        F.when(kind == C.UPGRADE, F.col("chosen_upgrade_id")).alias("chosen_upgrade_id"),
        "boss_archetype", "win")


@query
def fight_records(spark, sf_dir):
    """Fights decoded with the narrow schema."""
    return X.decode_fights(gameplay_records(spark, sf_dir), keep=("event_id",))


@query
def landed_by_day(spark, sf_dir):
    """Raw records landed by UTC day and read back with an inferred schema."""
    records = X.decode_events(gameplay_records(spark, sf_dir), keep=("value",)).withColumn(
        "record_time", F.timestamp_millis("timestamp"))
    path = _folder(spark, "landed")
    sinks.with_day(records).select("value", "dt").write.partitionBy("dt").option(
        "maxRecordsPerFile", "1000").text(path)
    landed = sources.read_landed(spark, path)
    return landed.groupBy(F.col("dt").cast("string").alias("dt"), "event_type").agg(
        F.count("*").alias("n"))


@query
def staged_events(spark, sf_dir):
    decoded = X.decode_events(gameplay_records(spark, sf_dir), keep=("event_id",))
    staged = sources.stage_raw_events(decoded.select(*ENVELOPE.fieldNames()))
    return staged.select("event_type", "timestamp", "player_id", "run_id", "dt")


@query
def record_lake(spark, sf_dir):
    """Boss records written to the lake by archetype and read back under its schema."""
    path = _folder(spark, "lake")
    records = R.training_records(gameplay_events(spark, sf_dir))
    sinks.append_lake(R.split_type(records)[1], path, "first")
    return shown(sources.read_lake(spark, path), total_damage_dealt=2, total_damage_taken=2,
                 damage_taken_from_elites=2)


@query
def seeded_lake(spark, sf_dir):
    """Boss records with the seed rows that are not among them yet."""
    records = stage(R.to_lake(R.split_type(R.training_records(
        gameplay_events(spark, sf_dir)))[1]), "records")
    seeds = sources.seed_rows(spark)
    once = union_all(records, sinks.new_seeds(records, seeds))
    twice = union_all(once, sinks.new_seeds(once, seeds))
    return twice.select("boss_archetype", "run_id", "encounterId", "weight", "total_dashes",
                        "outcome")


# --- filters and projections ---------------------------------------------------------------------

@on_events
def fight_events(events):
    return X.filter_type(events, *C.FIGHT_EVENTS).select("event_id", "event_type")


@on_events
def usable_fights(events):
    return X.with_archetype(X.filter_type(events, *C.FIGHT_EVENTS)).select(
        "event_id", "boss_archetype")


@on_events
def guarded_events(events):
    return X.guard_triggers(events).select("event_id", "event_type")


@on_events
def known_event_rows(events):
    return X.known_events(events).select("event_id", "run_id", "event_type")


@on_events
def fight_labels(events):
    labelled = R.with_weight(R.with_outcome(S.fights(events)))
    return labelled.select("event_id", "outcome", "weight")


@on_events
def enriched_records(events):
    return shown(R.training_records(events), total_damage_dealt=2, total_damage_taken=2,
                 damage_taken_from_elites=2)


@on_events
def training_rows(events):
    """The stored projection, with its archetype and oversampled as it is appended."""
    records = R.oversampled_fights(R.training_records(events))
    return shown(sinks.append_training(records, "", "", dry_run=True), total_damage_dealt=2,
                 total_damage_taken=2, damage_taken_from_elites=2)


@query
def bootstrap_tables(spark, sf_dir):
    """Training tables rebuilt from a lake of boss records, as read back from storage."""
    lake, path = _folder(spark, "lake"), _folder(spark, "training")
    records = R.training_records(gameplay_events(spark, sf_dir))
    sinks.append_lake(R.split_type(records)[1], lake, "first")
    run_bootstrap(spark, lake, path)
    stored = sinks.read_training(spark, path)
    return shown(stored.select("boss_archetype", *R.to_training(stored).columns),
                 total_damage_dealt=2, total_damage_taken=2, damage_taken_from_elites=2)


@on_events
def weight_parts(events):
    """Light and full records; unknown weights, here of the undecided, are in neither."""
    weighted = R.with_weight(S.fights(events)).withColumn(
        "weight", F.when(F.col("win").isNotNull(), F.col("weight")))
    light, full = R.split_weight(weighted)
    return union_all(light.select("event_id", F.lit("light").alias("part")),
                     full.select("event_id", F.lit("full").alias("part")))


@on_events
def type_parts(events):
    elite, boss = R.split_type(S.fights(events))
    return union_all(elite.select("event_id", F.lit("elite").alias("part")),
                     boss.select("event_id", F.lit("boss").alias("part")))


@on_events
def feature_summary(events):
    """Mean of every inferred feature."""
    records = R.training_records(events)
    names = R.infer_features(records.drop("event_id"))
    means = records.agg(*[F.avg(name).alias(name) for name in names])
    return shown(means.unpivot([], names, "feature", "mean"), mean=6)


@on_events
def labelled_records(events):
    known = S.fights(events).withColumn("outcome", F.col("win").cast("int"))
    return R.labelled(known).select("event_id", "outcome")


# --- joins ---------------------------------------------------------------------------------------

@on_events
def fights_with_final_features(events):
    joined = R.enrich(S.fights(events), E.feature_vectors(events))
    return shown(R.enriched_view(joined.withColumn("encounterId", F.lit(None).cast("string")))
                 .drop("encounterId"), total_damage_dealt=2, total_damage_taken=2,
                 damage_taken_from_elites=2)


@on_events
def fights_with_snapshots(events):
    met = union_all(X.filter_type(events, *C.TRIGGER_EVENTS).select("run_id"),
                    X.filter_type(events, *C.FIGHT_EVENTS).select("run_id"))
    found = S.asof_features(S.fights(events), S.snapshots(events, upgrades=False),
                            checked=large_keys(met) is None)
    return shown(found.select("event_id", "run_id", "boss_archetype", "win", "snapshot_id",
                              "encounterId", *NUMERIC_FEATURES),
                 total_damage_dealt=2, total_damage_taken=2, damage_taken_from_elites=2)


@on_events
def fights_without_snapshots(events):
    return S.unmatched_fights(events).select("event_id", "run_id", "boss_archetype")


@on_events
def kill_velocities(events):
    return A.carry_velocity(events).select("event_id", "run_id", "x", "y", "vx", "vy")


@on_events
def triggers_and_features(events):
    """Encounter triggers with the newest cached snapshot of their run."""
    cached = R.latest(S.snapshots(events, upgrades=False), "run_id", *ORDER)
    triggers = X.guard_triggers(X.filter_type(events, C.ENCOUNTER)).select(
        "event_id", "run_id", "encounter_id", "boss_archetype")
    return shown(O.triggers_with_features(triggers, cached).select(
        "event_id", "run_id", "encounter_id", "boss_archetype", "player_id", "total_dashes",
        "avg_hp_percent"))


@on_events
def features_of_final_fighters(events):
    """Features of the runs that met the final boss, by key."""
    keys = S.fights(events).filter("boss_archetype = 'final'")
    return R.lookup_features(keys, E.dash_count(events))


# --- aggregates ----------------------------------------------------------------------------------

@on_events
def dash_counts(events):
    return E.dash_count(events)


@on_events
def damage_totals(events):
    return shown(E.damage_sums(events), total_damage_dealt=2, total_damage_taken=2)


@on_events
def elite_damage_totals(events):
    return shown(E.elite_damage(events), damage_taken_from_elites=2)


@on_events
def recent_hp(events):
    return shown(E.avg_hp(events))


@query
def recent_hp_long_runs(spark, sf_dir):
    """The same over a few long runs, where the history overflows."""
    return shown(E.avg_hp(gameplay_events(spark, sf_dir, FEW_RUNS)))


@on_events
def upgrade_maps(events):
    return shown(E.upgrade_counts(events))


@on_events
def run_players(events):
    return E.run_player(events)


@query
def run_players_long_runs(spark, sf_dir):
    return E.run_player(gameplay_events(spark, sf_dir, FEW_RUNS))


@on_events
def run_features(events):
    return shown(E.feature_vectors(events), total_damage_dealt=2, total_damage_taken=2,
                 damage_taken_from_elites=2)


@on_events
def archetypes_seen(events):
    return E.distinct_keys(S.fights(events), "boss_archetype")


@on_events
def record_counts(events):
    return R.batch_metrics(R.training_records(events))


# --- point-in-time windows -----------------------------------------------------------------------

_SNAPSHOT = ("event_id", "run_id", "player_id", "event_type", "boss_archetype", "encounterId",
             *NUMERIC_FEATURES)


@on_events
def run_snapshots(events):
    return shown(S.snapshots(events).select(*_SNAPSHOT, "upgrade_counts"), total_damage_dealt=2,
                 total_damage_taken=2, damage_taken_from_elites=2)


@query
def run_snapshots_long_runs(spark, sf_dir):
    events = gameplay_events(spark, sf_dir, FEW_RUNS)
    return shown(S.snapshots(events).select(*_SNAPSHOT, "upgrade_counts"), total_damage_dealt=2,
                 total_damage_taken=2, damage_taken_from_elites=2)


@on_events
def newest_snapshots(events):
    taken = R.latest(S.snapshots(events, upgrades=False), "run_id", *ORDER)
    return shown(taken.select(*_SNAPSHOT), total_damage_dealt=2, total_damage_taken=2,
                 damage_taken_from_elites=2)


@on_events
def upgrades_at_triggers(events):
    return shown(S.running_upgrades(events))


@on_events
def dash_modes(events):
    return A.dash_mode(events).select("event_id", "run_id", "direction", "prediction")


@on_events
def prediction_changes(events):
    return A.prediction_updates(events)


@on_events
def prediction_changes_daily(events):
    """A tick of a day, so that ticks hold several dashes."""
    return A.prediction_updates(events, tick_ms=DAY_MS)


@on_events
def kill_alignments(events):
    return shown(A.kill_alignment(events).select("event_id", "run_id", "cosine", "alignment"))


@query
def kill_alignments_long_runs(spark, sf_dir):
    events = gameplay_events(spark, sf_dir, FEW_RUNS)
    return shown(A.kill_alignment(events).select("event_id", "run_id", "cosine", "alignment"))


@on_events
def enemy_forms(events):
    return A.brute_forms(events, last_n=4, min_n=2).select("event_id", "run_id", "form")


@query
def enemy_forms_long_runs(spark, sf_dir):
    return A.brute_forms(gameplay_events(spark, sf_dir, FEW_RUNS)).select(
        "event_id", "run_id", "form")


@on_events
def enemy_form_changes(events):
    return A.form_changes(events).select("event_id", "run_id", "form")


@on_events
def stale_enemy_forms(events):
    """Form messages with staleness up to the last event."""
    horizon = events.agg(F.max("timestamp")).first()[0]
    return A.stale_forms(events, horizon, STALE_MS, STALE_MS, last_n=4, min_n=2)


@on_events
def z_scores(events):
    scored = R.standardise(stored_records(events))
    return shown(scored.select("event_id", "boss_archetype", *NUMERIC_FEATURES),
                 **{name: 6 for name in NUMERIC_FEATURES})


# --- top-k and sets ------------------------------------------------------------------------------

def outcome_gaps(records: DataFrame) -> DataFrame:
    """Difference of each feature's mean between won and lost fights, as a weight per archetype."""
    won = F.col("outcome") == 1
    gaps = records.groupBy("boss_archetype").agg(*[
        (F.avg(F.when(won, F.col(name).cast("double")))
         - F.avg(F.when(~won, F.col(name).cast("double")))).alias(name)
        for name in NUMERIC_FEATURES])
    return gaps.unpivot(["boss_archetype"], list(NUMERIC_FEATURES), "feature", "weight")


@on_events
def leading_features(events):
    return M.top_features(outcome_gaps(R.training_records(events)))


@on_events
def newest_dashes(events):
    return newest(X.filter_type(events, C.DASH), ["run_id"], ORDER, C.DASH_HISTORY).select(
        "event_id", "run_id")


@on_events
def oversampled_records(events):
    return R.oversampled_fights(R.with_weight(S.fights(events))).select(
        "event_id", "event_type", "weight")


@on_events
def united_fights(events):
    fights = S.fights(events)
    elite, boss = R.split_type(fights)
    return union_all(elite, boss, boss).select("event_id", "event_type")


# --- scalar expressions --------------------------------------------------------------------------

@on_events
def dash_directions(events):
    direction = vectors.dash_direction(F.col("x"), F.col("y"))
    unit = vectors.unit_vector(direction)
    return X.filter_type(events, C.DASH).select(
        "event_id", direction.alias("direction"), unit["dx"].cast("int").alias("dx"),
        unit["dy"].cast("int").alias("dy"))


@on_events
def hp_ratios(events):
    return X.filter_type(events, C.STATUS).select("event_id", F.round(
        vectors.hp_ratio(F.col("hp"), F.col("max_hp")), 9).alias("ratio"))


@on_events
def encounter_ids(events):
    return X.guard_triggers(X.filter_type(events, *C.TRIGGER_EVENTS)).select(
        "event_id", payload.encounter_or_new(
            F.col("encounter_id"), F.col("run_id"), F.col("timestamp")).alias("encounter_id"))


@on_events
def form_messages(events):
    rows = A.with_player(A.form_changes(events), events)
    return to_messages(rows, C.FORM_MESSAGE, "event_id")


@on_events
def prediction_messages(events):
    rows = A.with_player(A.prediction_updates(events), events)
    return to_messages(rows, C.PREDICTION_MESSAGE, "run_id", "moment")


@on_events
def trigger_messages(events):
    return to_messages(X.guard_triggers(X.filter_type(events, C.ENCOUNTER)), C.TRIGGERS_TOPIC,
                       "event_id")


# --- offers --------------------------------------------------------------------------------------

def scored_triggers(events: DataFrame) -> DataFrame:
    """Encounter triggers with scores and reply texts derived from their events."""
    names = F.array(*[F.lit(name) for name in (*NUMERIC_FEATURES, "combo_length")])
    k = F.col("k")
    replies = F.array(
        F.lit('Behold: {"dialogue":"Beware.","bargain_descriptions":["First.","Second."]} Done'),
        F.lit('{"dialogue":"Alone.","bargain_descriptions":["Only."]}'),
        F.lit("{}"), F.lit("The mist hides all."), F.lit('{"dialogue": }'))
    return X.guard_triggers(X.filter_type(events, C.ENCOUNTER)).select(
        "event_id", "run_id", "player_id", "boss_archetype",
        F.coalesce("encounter_id", F.lit(C.DEFAULT_ENCOUNTER)).alias("encounter_id"),
        F.when(k % 7 != 0, F.when(k % 2 == 0, "Win").otherwise("Loss")).alias("prediction"),
        F.when(k % 7 != 0, k % 61 / F.lit(100.0) + 0.4).alias("confidence"),
        F.get(names, k % 6).alias("primary_feature"),
        F.get(names, (k / 6).cast("int") % 6).alias("secondary_feature"),
        F.get(replies, (F.col("event_id") % 5).cast("int")).alias("reply"))


def _offered(rows: DataFrame, *extra: str | Column) -> DataFrame:
    def effect(slot: int) -> Column:
        choice = F.col("choices")[slot]
        return F.coalesce(F.get(choice["buffs"], F.lit(0)), F.get(choice["debuffs"], F.lit(0)))

    return rows.select(
        *extra, "dialogue", *[F.col("choices")[slot]["description"].alias(f"description_{slot}")
                              for slot in (0, 1)],
        *[effect(slot)["modifier"].alias(f"modifier_{slot}") for slot in (0, 1)],
        F.when(F.size(F.col("choices")[0]["buffs"]) > 0, "buffs").otherwise("debuffs").alias(
            "kind"))


@on_events
def bargain_offers(events):
    return _offered(O.offers(scored_triggers(events)), "event_id")


@on_events
def fallback_offers(events):
    """What every trigger would be offered without any model."""
    rows = scored_triggers(events).withColumns({
        "dialogue": F.lit(C.FALLBACK_DIALOGUE), "choices": O.fallback_choices()})
    return _offered(rows, "event_id")


@on_events
def result_messages(events):
    return to_messages(O.offers(scored_triggers(events)), C.RESULT_MESSAGE, "event_id")


@on_events
def bargain_pools(events):
    rows = scored_triggers(events).withColumn("polarity", effects.polarity(F.col("prediction")))
    pools = O.bargain_pool(rows, "primary_feature", "pool")
    return pools.select("event_id", "polarity", F.size("pool").alias("n"),
                        F.col("pool")[0]["targetStat"].alias("first_stat"))


@on_events
def chosen_effects(events):
    """Keyed choice, scaling and wording of one effect."""
    rows = scored_triggers(events).withColumn("polarity", effects.polarity(F.col("prediction")))
    rows = O.bargain_pool(rows, "primary_feature", "pool").withColumn(
        "effect", O.scaled_effect(F.col("pool"), F.col("confidence"), 0))
    return rows.select("event_id", "effect.targetStat", "effect.modifier", effects.effect_text(
        F.col("effect")).alias("wording"))


@on_events
def bargain_prompts(events):
    return O.render_prompt(scored_triggers(events)).select("event_id", "prompt")


@on_events
def parsed_replies(events):
    parsed = scored_triggers(events).withColumn("parsed", text.parse_reply(F.col("reply")))
    return parsed.select(
        "event_id", "parsed.dialogue",
        F.when(F.col("parsed").isNotNull(), effects.description_at(
            F.col("parsed.descriptions"), 1)).alias("second"))


# --- feature cache -------------------------------------------------------------------------------

def _cached(spark: SparkSession, events: DataFrame) -> str:
    """A cache that got the snapshots in ten batches, merged on the way."""
    path, taken = _folder(spark, "cache"), S.snapshots(events, upgrades=False)
    taken = replay.by_slice(taken.withColumn("upgrade_counts", F.create_map().cast(
        "map<string,int>")), replay.time_cuts(taken, SLICES))
    for number in range(SLICES):
        cache.upsert_latest(taken.filter(F.col("slice") == number), path, f"batch-{number}", 3)
    return path


_CACHED = ("event_id", "run_id", "player_id", "boss_archetype", "encounterId", *NUMERIC_FEATURES)


@query
def cached_features(spark, sf_dir):
    """Newest snapshot per run, as read back from the cache."""
    path = _cached(spark, gameplay_events(spark, sf_dir))
    return shown(cache.read_features(spark, path).select(*_CACHED), total_damage_dealt=2,
                 total_damage_taken=2, damage_taken_from_elites=2)


@query
def cached_features_of_final_fighters(spark, sf_dir):
    """The same for the runs that met the final boss, by key, after all batches became one."""
    events = gameplay_events(spark, sf_dir)
    path = _cached(spark, events)
    cache.compact_features(spark, path)
    keys = S.fights(events).filter("boss_archetype = 'final'")
    return shown(cache.read_features(spark, path, keys).select(*_CACHED), total_damage_dealt=2,
                 total_damage_taken=2, damage_taken_from_elites=2)


# --- models --------------------------------------------------------------------------------------

@on_events
def model_weights(events):
    """Weights of the fitted models, from the oversampled training rows."""
    return M.feature_weights(M.train(R.oversampled_fights(R.training_records(events)),
                                     features=NUMERIC_FEATURES))


def given_weights(records: DataFrame) -> DataFrame:
    """A model of set weights per archetype but the last, scaled by the figures of `records`."""
    figures = records.filter(F.col("boss_archetype") != "final").groupBy("boss_archetype").agg(
        F.array(*[F.struct(
            F.lit(name).alias("feature"), F.lit(0.5 - 0.3 * at).alias("weight"),
            F.avg(F.col(name).cast("double")).alias("mean"),
            F.stddev_pop(F.col(name).cast("double")).alias("sd"))
            for at, name in enumerate(NUMERIC_FEATURES)]).alias("terms"))
    return figures.select("boss_archetype", F.explode("terms").alias("t")).select(
        "boss_archetype", "t.*", F.lit(0.1).alias("intercept"))


@on_events
def scored_by_given_weights(events):
    """Training records scored by a table of weights; archetypes without a model stay null."""
    records = R.training_records(events)
    return M.score(records, given_weights(records)).select(
        "event_id", "boss_archetype", "prediction", F.round("win_probability", 6).alias("win"),
        F.round("confidence", 6).alias("confidence"), "primary_feature", "secondary_feature")


@on_events
def fit_optimality(events):
    """Whether each fit is one: the loss is flat in every weight, and below that of the base rate."""
    rows = stage(R.oversampled_fights(R.training_records(events)), "fitted")
    weights = M.train(rows, features=NUMERIC_FEATURES)
    scored = M.score(rows, weights).join(weights.groupBy("boss_archetype").agg(F.map_from_entries(
        F.collect_list(F.struct("feature", F.struct("mean", "sd")))).alias("scale")),
        "boss_archetype")
    y, p = F.col("outcome").cast("double"), F.col("win_probability")

    def loss(p):
        return -F.avg(y * F.log(F.greatest(p, F.lit(1e-12))) + (1 - y) * F.log(
            F.greatest(1 - p, F.lit(1e-12))))

    def slope(name):
        scale = F.col("scale")[name]
        return F.avg(F.when(scale["sd"] != 0, (p - y) * (F.col(name) - scale["mean"]) / scale["sd"]
                            ).otherwise(0.0))

    base = F.avg(y)
    figures = scored.groupBy("boss_archetype").agg(
        loss(p).alias("loss"), base.alias("base"),
        F.array(*[F.struct(F.lit(name).alias("feature"), slope(name).alias("slope"))
                  for name in NUMERIC_FEATURES]).alias("slopes"))
    at_base = -(F.col("base") * F.log(F.greatest("base", F.lit(1e-12))) + (1 - F.col("base")) *
                F.log(F.greatest(1 - F.col("base"), F.lit(1e-12))))
    return figures.select("boss_archetype", F.explode("slopes").alias("s"), (
        F.col("loss") <= at_base + 1e-9).alias("better")).select(
        "boss_archetype", "s.feature", (F.abs("s.slope") < 1e-6).alias("flat"), "better")


@on_events
def scored_encounters(events):
    """Every encounter snapshot scored by the model of its archetype, and offered a bargain."""
    weights = M.train(R.oversampled_fights(R.training_records(events)),
                      features=NUMERIC_FEATURES)
    taken = S.snapshots(events, upgrades=False).filter(F.col("event_type") == C.ENCOUNTER)
    replied = M.score(taken, weights).withColumn("reply", F.lit("{}"))
    return _offered(O.offers(replied), "event_id", "boss_archetype", "prediction", "confidence",
                    "primary_feature", "secondary_feature")


# --- commentary ----------------------------------------------------------------------------------

def comment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per conversation turn: its role as the fact's name, its length as value."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(
            F.lit("a weary "), F.col("role"))).alias("npc_personality"),
        F.when(F.col("conv_id") % 9 != 0, F.struct(
            F.when(F.col("conv_id") % 7 != 0, F.concat(F.col("role"), F.lit("_chars"))).alias(
                "Key"),
            F.length("text").cast("string").alias("Value"))).alias("statistic_to_comment_on"),
        F.when(F.col("turn") % 3 != 0, F.concat(F.lit('  "'), F.col("text"), F.lit('" '))).alias(
            "reply"))


@query
def comment_prompts(spark, sf_dir):
    usable, _ = comments.valid_requests(comment_requests(spark, sf_dir))
    return comments.with_comment_prompt(usable).select("conv_id", "turn", "prompt")


@query
def rejected_requests(spark, sf_dir):
    return comments.valid_requests(comment_requests(spark, sf_dir))[1].select("conv_id", "turn")


@query
def clean_comments(spark, sf_dir):
    return comments.with_clean_reply(comment_requests(spark, sf_dir)).select(
        "conv_id", "turn", F.md5(F.col("comment").cast("binary")).alias("comment_md5"))


# --- streams -------------------------------------------------------------------------------------

class Replayed:
    """Tables of one time fed to a stream in slices of the first one's time, and its watermark."""

    def __init__(self, spark: SparkSession, events: DataFrame, *tables: DataFrame,
                 slices: int = SLICES) -> None:
        self.slices = slices
        cuts = replay.time_cuts(tables[0], slices)
        low, self.high, rows = events.agg(
            F.min("timestamp"), F.max("timestamp"), F.count("*")).first()
        self.spark, self.partitions = spark, state_partitions(spark, rows)
        self.parts = state_parts(spark, rows)
        self.delay_ms = replay.longest(cuts, low, self.high)
        # Each table comes a slice later than the one before, so the watermark waits for it.
        self.feeds = replay.side_by_side([replay.by_slice(table, cuts) for table in tables],
                                         _folder(spark, "fed"))

    @property
    def delay(self) -> str:
        return f"{self.delay_ms} milliseconds"

    def run(self, start: Callable, past: int = 0, **clock) -> None:
        """All slices with a restart in between, until the watermark is `past` the last event."""
        def started(**trigger):
            with shuffled_into(self.spark, self.partitions):
                return start(**trigger)

        replay.replay(self.feeds, self.slices, started, restarts=(self.slices // 2,),
                      closing=lambda fed: fed.put_clock(self.high + past + self.delay_ms, **clock))


def _written(output: DataFrame, path: str, **trigger):
    """Start a stream that writes its rows to a folder."""
    return output.writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/checkpoint").trigger(
            **(trigger or {"processingTime": "0 seconds"})).start()


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outputs of the stateful profile run over the whole table in order of time, to its end."""
    events = gameplay_events(spark, sf_dir).select(*FLAT_EVENT.fieldNames())
    replayed = Replayed(spark, events, events)
    (fed,) = replayed.feeds
    rules = P.Rules(kill_history=4, kill_min=2, stale_ms=STALE_MS, grace_ms=STALE_MS)
    path = _folder(spark, "profile")

    def start(**trigger):
        return _written(P.profile_stream(X.guard_triggers(fed.watched()), rules, event_time=True,
                                         delay=replayed.delay), path, **trigger)

    replayed.run(start, event_type="none")
    return spark.read.schema(P.OUTPUT).parquet(f"{path}/out")


@query
def streamed_snapshots(spark, sf_dir):
    return shown(P.snapshots_of(_streamed(spark, sf_dir)).select(
        "event_id", "run_id", "player_id", "boss_archetype", "encounterId", *NUMERIC_FEATURES,
        "upgrade_counts"), total_damage_dealt=2, total_damage_taken=2,
        damage_taken_from_elites=2)


@query
def streamed_forms(spark, sf_dir):
    return P.forms_of(_streamed(spark, sf_dir)).select(
        "run_id", F.col("timestamp").alias("moment"), "form")


@query
def streamed_predictions(spark, sf_dir):
    return P.predictions_of(_streamed(spark, sf_dir)).select(
        "run_id", F.col("timestamp").alias("moment"), "prediction")


@query
def streamed_fights_with_snapshots(spark, sf_dir):
    """Fights joined in the stream; snapshots arrive a slice later than the fights of their time."""
    events = gameplay_events(spark, sf_dir)
    replayed = Replayed(spark, events, S.fights(events), S.snapshots(events))
    fights, taken = replayed.feeds
    path = _folder(spark, "asof")

    def start(**trigger):
        return _written(asof.asof_stream(fights.watched(), taken.watched(), replayed.delay,
                                         idle_ms=None, parts=replayed.parts), path, **trigger)

    replayed.run(start, past=1)
    found = asof.matched(spark.read.schema(asof.OUTPUT).parquet(f"{path}/out"))
    return shown(found.select("event_id", "run_id", "boss_archetype", "win", "snapshot_id",
                              "encounterId", *NUMERIC_FEATURES),
                 total_damage_dealt=2, total_damage_taken=2, damage_taken_from_elites=2)


def _enriched(spark: SparkSession, sf_dir: str, slices: int) -> tuple[str, str]:
    """Folders of the training tables and of the counts that the enrichment job has written."""
    events = gameplay_events(spark, sf_dir)
    replayed = Replayed(spark, events, S.fights(events), S.snapshots(events), slices=slices)
    fights, taken = replayed.feeds
    path = _folder(spark, "enrichment")
    sinks.ensure_tables(spark, f"{path}/training")

    def start(**trigger):
        return start_asof_enrichment(
            fights.watched(), taken.watched(), f"{path}/lake", f"{path}/training", f"{path}/side",
            f"{path}/checkpoint", replayed.delay, idle_ms=None, parts=replayed.parts, **trigger)

    replayed.run(start, past=1)
    return f"{path}/training", f"{path}/side"


@query
def streamed_training_rows(spark, sf_dir):
    """Training tables as the enrichment job appends them, batch by batch."""
    stored = sinks.read_training(spark, _enriched(spark, sf_dir, SLICES)[0])
    return shown(stored.select("boss_archetype", *R.to_training(stored).columns),
                 total_damage_dealt=2, total_damage_taken=2, damage_taken_from_elites=2)


@query
def audited_enrichment(spark, sf_dir):
    """Counts of the enrichment job, summed over its batches."""
    counts = audit_counts(spark, _enriched(spark, sf_dir, 3)[1])
    return counts.agg(*[F.sum(name).alias(name) for name in AUDIT.fieldNames()])


INGEST_DELAY_MS = 2 * DAY_MS


def _broken(records: DataFrame) -> DataFrame:
    """Every kind of bad record, made from the good ones."""
    at = F.col("event_id")
    return records.withColumn("value", F.when(at % 11 == 0, F.expr("left(value, 20)"))
                              .when(at % 13 == 0, "").when(at % 17 == 0, "null")
                              .when(at % 19 == 0, F.replace("value", F.lit("run_id"), F.lit("r")))
                              .otherwise(F.col("value")))


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Folder of an ingest in turns: some records come twice in a turn, some again in the next, some
    only after all others."""
    times = gameplay_events(spark, sf_dir).select("event_id", "timestamp")
    cuts = replay.even_cuts(times, SLICES)
    records = _broken(gameplay_records(spark, sf_dir)).join(times, "event_id")
    records = records.withColumn("slice", replay.slice_number(cuts))
    at = F.col("event_id")
    held, rest = records.filter(at % 23 == 0), records.filter(at % 23 != 0)
    turns = union_all(
        rest, rest.filter(at % 7 == 0), rest.filter(at % 5 == 0).withColumn(
            "slice", F.col("slice") + 1), held.withColumn("slice", F.lit(SLICES)))
    path = _folder(spark, "ingest")
    fed = replay.Feed(replay.stored(turns), f"{path}/topic")

    def start(**trigger):
        return ingest.start_ingest(fed.watched().select("event_id", "value"), path,
                                   f"{path}/checkpoint", INGEST_DELAY_MS, **trigger)

    replay.replay([fed], SLICES + 1, start)
    return path


@query
def ingested_records(spark, sf_dir):
    """How often each event was stored with each status."""
    stored = ingest.read_records(spark, _ingested(spark, sf_dir))
    return stored.groupBy("event_id", "status").agg(F.count("*").alias("n"))


@query
def features_of_ingested_events(spark, sf_dir):
    """Dashes and damage of each run, from the stored good events."""
    events = ingest.read_good(spark, _ingested(spark, sf_dir), streaming=False)
    return shown(E.damage_sums(events).join(E.dash_count(events), "run_id"),
                 total_damage_dealt=2, total_damage_taken=2)


@query
def run_features_delivered_twice(spark, sf_dir):
    """Feature vectors of events of which a third comes twice: the same as without."""
    records = gameplay_records(spark, sf_dir)
    good, _ = X.split_valid(union_all(records, records.filter("event_id % 3 = 0")), ("event_id",))
    return shown(E.feature_vectors(X.flatten_payload(good)), total_damage_dealt=2,
                 total_damage_taken=2, damage_taken_from_elites=2)
