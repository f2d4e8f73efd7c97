"""DuckDB SQL for the registered queries.

Each statement starts from the given tables; shared steps are common table expressions, so that the
SQL reads in the order of the work.
"""

from __future__ import annotations

from runlens import constants as C

_FIELDS = ("total_dashes", "total_damage_dealt", "total_damage_taken", "damage_taken_from_elites",
           "avg_hp_percent")
_MONEY = """round(total_damage_dealt, 2) AS total_damage_dealt,
  round(total_damage_taken, 2) AS total_damage_taken,
  round(damage_taken_from_elites, 2) AS damage_taken_from_elites,
  round(avg_hp_percent, 9) AS avg_hp_percent"""
_FEATURES = f"total_dashes, {_MONEY}"
_TRIGGER = "event_type IN ('seer_encounter_begin', 'elite_fight_completed')"
_FIGHT = "event_type IN ('boss_fight_completed', 'elite_fight_completed')"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def gameplay(user: str = "user_id") -> str:
    """CTE `g`: gameplay events of the whole events table."""
    return f"""
raw AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events
),
g AS (
  SELECT event_id, epoch_us(ts) // 1000 AS timestamp, 'player_' || user_id AS player_id,
    'run_' || ({user}) AS run_id, k,
    CASE event_type
      WHEN 'click' THEN 'player_dash_event'
      WHEN 'error' THEN 'damage_taken_event'
      WHEN 'purchase' THEN
        CASE WHEN event_id % 2 = 0 THEN 'player_damage_dealt_event' ELSE 'upgrade_choice' END
      WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 'player_status_event'
        WHEN 1 THEN 'player_movement_event' ELSE 'enemy_death_event' END
      WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'seer_encounter_begin'
        WHEN 1 THEN 'boss_fight_completed' ELSE 'elite_fight_completed' END
    END AS event_type,
    CAST(k % 7 - 3 AS DOUBLE) AS x, CAST(k % 5 - 2 AS DOUBLE) AS y,
    CASE WHEN k % 5 = 0 THEN 0.0::DOUBLE ELSE value END AS dmg, k % 3 = 0 AS is_elite,
    k::DOUBLE AS hp, CASE WHEN k % 10 = 0 THEN 0.0 ELSE 100.0 END::DOUBLE AS max_hp,
    CASE WHEN k % 6 = 0 THEN 'unknown' ELSE 'upg_' || (k % 4) END AS upg,
    CASE WHEN k % 8 <> 0 THEN 'enc_' || event_id END AS enc,
    CASE k % 5 WHEN 0 THEN 'melee' WHEN 1 THEN 'ranged' WHEN 2 THEN 'final'
      WHEN 3 THEN 'none' END AS arch,
    CASE WHEN k % 9 <> 0 THEN k % 2 = 0 END AS win
  FROM raw
),
e AS (
  SELECT * FROM g WHERE NOT ({_TRIGGER}) OR coalesce(arch, 'none') <> 'none'
)"""


G = gameplay()
G_LONG = gameplay("user_id % 4")

_FIRST_PLAYER = f"""first(player_id ORDER BY timestamp, event_id) FILTER (
  player_id IS NOT NULL AND event_type <> 'boss_fight_completed'
  AND (NOT ({_TRIGGER}) OR coalesce(arch, 'none') <> 'none'))"""

_CONTRIBUTIONS = """
  CASE WHEN event_type = 'player_dash_event' THEN 1 ELSE 0 END AS dash,
  CASE WHEN event_type = 'player_damage_dealt_event' THEN dmg ELSE 0 END AS dealt,
  CASE WHEN event_type = 'damage_taken_event' THEN dmg ELSE 0 END AS taken,
  CASE WHEN event_type = 'damage_taken_event' AND is_elite THEN dmg ELSE 0 END AS elite,
  CASE WHEN event_type = 'player_status_event' AND max_hp > 0 THEN hp / max_hp END AS ratio"""


def snapshots(base: str) -> str:
    """CTE `snap`: feature vector at each usable trigger, with its upgrade map as text."""
    return f"""{base},
p AS (SELECT *, {_CONTRIBUTIONS} FROM e),
running AS (
  SELECT event_id, run_id, timestamp, event_type, arch, enc,
    first_value(CASE WHEN event_type <> 'boss_fight_completed' THEN player_id END IGNORE NULLS)
      OVER w AS player_id,
    (sum(dash) OVER w)::BIGINT AS total_dashes, sum(dealt) OVER w AS total_damage_dealt,
    sum(taken) OVER w AS total_damage_taken, sum(elite) OVER w AS damage_taken_from_elites,
    list(ratio) FILTER (ratio IS NOT NULL) OVER w AS ratios
  FROM p WINDOW w AS (PARTITION BY run_id ORDER BY timestamp, event_id)
),
upgrades AS (
  SELECT event_id, '{{' || string_agg('"' || upg || '":' || n, ',' ORDER BY upg) || '}}' AS counts
  FROM (
    SELECT t.event_id, u.upg, count(*) AS n FROM e t JOIN e u ON t.run_id = u.run_id
      AND u.event_type = 'upgrade_choice' AND (u.timestamp, u.event_id) < (t.timestamp, t.event_id)
    WHERE t.{_TRIGGER} GROUP BY t.event_id, u.upg
  ) GROUP BY event_id
),
snap AS (
  SELECT r.* EXCLUDE (ratios), coalesce(list_avg(ratios[-100:]), 1.0) AS avg_hp_percent,
    coalesce(enc, sha256(run_id || timestamp)) AS encounter, coalesce(counts, '{{}}') AS counts
  FROM running r LEFT JOIN upgrades USING (event_id) WHERE {_TRIGGER}
)"""


SNAP = snapshots(G)

FINAL = f"""{G},
p AS (SELECT *, {_CONTRIBUTIONS} FROM e WHERE event_type <> 'boss_fight_completed'),
hp AS (
  SELECT run_id, avg(ratio) AS avg_hp FROM (
    SELECT run_id, ratio, row_number() OVER (
      PARTITION BY run_id ORDER BY timestamp DESC, event_id DESC) AS rn
    FROM p WHERE ratio IS NOT NULL) WHERE rn <= 100 GROUP BY run_id
),
maps AS (
  SELECT run_id, '{{' || string_agg('"' || upg || '":' || n, ',' ORDER BY upg) || '}}' AS counts
  FROM (SELECT run_id, upg, count(*) AS n FROM e WHERE event_type = 'upgrade_choice'
        GROUP BY run_id, upg) GROUP BY run_id
),
vectors AS (
  SELECT run_id, arg_min(player_id, timestamp) AS player_id, sum(dash)::BIGINT AS total_dashes,
    sum(dealt) AS total_damage_dealt, sum(taken) AS total_damage_taken,
    sum(elite) AS damage_taken_from_elites, coalesce(any_value(avg_hp), 1.0) AS avg_hp_percent,
    coalesce(any_value(counts), '{{}}') AS upgrade_counts
  FROM p LEFT JOIN hp USING (run_id) LEFT JOIN maps USING (run_id) GROUP BY run_id
)"""

FIGHTS = f"""{G},
f AS (SELECT event_id, run_id, timestamp, event_type, arch, win FROM g
  WHERE {_FIGHT} AND arch <> 'none')"""

RECORDS = f"""{SNAP},
f AS (SELECT event_id, run_id, timestamp, event_type, arch, win FROM g
  WHERE {_FIGHT} AND arch <> 'none'),
rec AS (
  SELECT f.event_id, f.run_id, f.arch AS boss_archetype, s.total_dashes, s.total_damage_dealt,
    s.total_damage_taken, s.damage_taken_from_elites, s.avg_hp_percent,
    s.counts AS upgrade_counts, CASE WHEN f.win THEN 1 ELSE 0 END AS outcome,
    CASE WHEN f.event_type = 'boss_fight_completed' THEN 1.0 ELSE 0.1 END::DOUBLE AS weight,
    f.event_type, s.encounter AS "encounterId", s.event_id AS snapshot_id, f.win
  FROM f ASOF JOIN snap s ON f.run_id = s.run_id AND f.timestamp >= s.timestamp
)"""

INGESTED = f"""{G},
r AS (SELECT event_id, timestamp, event_id % 23 = 0 AS held, event_id % 11 <> 0
    AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AS valid FROM g),
span AS (SELECT min(timestamp) AS low, max(timestamp) AS high FROM r),
s AS (SELECT r.*, len(list_filter(range(1, 10), lambda k:
    timestamp >= low + (high - low) * k // 10)) AS slice FROM r, span),
marks AS (SELECT turn, max(timestamp) - 172800000 AS mark
  FROM (SELECT unnest(range(1, 11)) AS turn) JOIN s ON NOT held AND valid AND slice < turn
  GROUP BY turn),
sent AS (
  SELECT event_id, timestamp, valid, slice AS turn, false AS again FROM s WHERE NOT held
  UNION ALL SELECT event_id, timestamp, valid, slice, true FROM s
    WHERE NOT held AND event_id % 7 = 0
  UNION ALL SELECT event_id, timestamp, valid, slice + 1, true FROM s
    WHERE NOT held AND event_id % 5 = 0
  UNION ALL SELECT event_id, timestamp, valid, 10, false FROM s WHERE held),
judged AS (SELECT event_id, CASE WHEN NOT valid THEN 'quarantined'
    WHEN timestamp < mark THEN 'late' WHEN again THEN 'repeated' ELSE 'good' END AS status
  FROM sent LEFT JOIN marks USING (turn))"""

_SEEDS = ", ".join(
    f"({text(a)}, {text(r)}, {text(e)}, {w}::DOUBLE, {n}, {d}::DOUBLE, {t}::DOUBLE, {x}::DOUBLE, "
    f"{h}::DOUBLE, {o})" for a, r, e, w, n, d, t, x, h, o in C.SEED_ROWS)
SEEDS = f"""seeds(boss_archetype, run_id, "encounterId", weight, total_dashes, total_damage_dealt,
  total_damage_taken, damage_taken_from_elites, avg_hp_percent, outcome) AS (VALUES {_SEEDS})"""

_DIRECTION = """CASE WHEN abs(x) > abs(y) THEN CASE WHEN x > 0 THEN 'right' ELSE 'left' END
  ELSE CASE WHEN y > 0 THEN 'up' ELSE 'down' END END"""

DASHES = f"""{G},
d AS (SELECT event_id, run_id, timestamp, {_DIRECTION} AS direction,
  list({_DIRECTION}) OVER (PARTITION BY run_id ORDER BY timestamp, event_id
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent,
  min(timestamp) OVER (PARTITION BY run_id) AS since
  FROM g WHERE event_type = 'player_dash_event'),
seen AS (SELECT event_id, unnest(recent) AS name, unnest(range(len(recent))) AS place FROM d),
tally AS (SELECT event_id, name, row_number() OVER (
    PARTITION BY event_id ORDER BY count(*) DESC, max(place) DESC) AS rn
  FROM seen GROUP BY event_id, name),
modes AS (SELECT d.*, name AS prediction FROM d JOIN tally USING (event_id) WHERE rn = 1)"""


def predictions(tick_ms: int) -> str:
    return f"""{DASHES},
ticked AS (SELECT *, greatest(CAST(ceil((timestamp - since) / {tick_ms}.0) AS BIGINT), 1) AS tick
  FROM modes),
last_of_tick AS (SELECT * FROM ticked QUALIFY row_number() OVER (
  PARTITION BY run_id, tick ORDER BY timestamp DESC, event_id DESC) = 1),
changed AS (SELECT run_id, since + tick * {tick_ms} AS moment, prediction FROM last_of_tick
  QUALIFY prediction <> lag(prediction, 1, 'none') OVER (PARTITION BY run_id ORDER BY tick))"""


def kills(base: str, last_n: int = 20, min_n: int = 5) -> str:
    """CTE `al`: cosine and recent mean at each kill, added from the newest on."""
    return f"""{base},
moves AS (SELECT *, last_value(CASE WHEN event_type = 'player_movement_event' THEN
    struct_pack(x := x, y := y) END IGNORE NULLS) OVER (
    PARTITION BY run_id ORDER BY timestamp, event_id) AS v
  FROM g WHERE event_type IN ('player_movement_event', 'enemy_death_event')),
vel AS (SELECT event_id, run_id, timestamp, x, y, coalesce(v.x, 0.0) AS vx, coalesce(v.y, 0.0) AS vy
  FROM moves WHERE event_type = 'enemy_death_event'),
cos AS (SELECT *, CASE WHEN vx * vx + vy * vy > 0 AND x * x + y * y > 0 THEN
    (vx / sqrt(vx * vx + vy * vy)) * (x / sqrt(x * x + y * y))
    + (vy / sqrt(vx * vx + vy * vy)) * (y / sqrt(x * x + y * y)) END AS cosine FROM vel),
hist AS (SELECT *, list(cosine) FILTER (cosine IS NOT NULL) OVER (
    PARTITION BY run_id ORDER BY timestamp, event_id) AS seen FROM cos),
al AS (SELECT * EXCLUDE (seen), CASE WHEN len(seen) >= {min_n} THEN list_reduce(
    list_prepend(0.0::DOUBLE, list_reverse(seen[-{last_n}:])), lambda a, b: a + b)
    / least(len(seen), {last_n}) END AS alignment FROM hist)"""


def forms(base: str, last_n: int = 20, min_n: int = 5) -> str:
    """CTE `fm`: enemy form after each kill, one kill after the other."""
    return f"""{kills(base, last_n, min_n)},
numbered AS (SELECT *, row_number() OVER (
  PARTITION BY run_id ORDER BY timestamp, event_id) AS i FROM al),
fm AS (
  SELECT run_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS timestamp,
    'skirmisher' AS form, false AS changed
  FROM numbered GROUP BY run_id
  UNION ALL
  SELECT n.run_id, n.i, n.event_id, n.timestamp, t.form, t.form <> fm.form
  FROM fm JOIN numbered n ON n.run_id = fm.run_id AND n.i = fm.i + 1,
  LATERAL (SELECT CASE WHEN n.alignment IS NULL THEN fm.form
    WHEN n.alignment < -0.2 THEN 'juggernaut' WHEN n.alignment > 0.6 THEN 'skirmisher'
    WHEN fm.form = 'juggernaut' THEN 'skirmisher' ELSE 'juggernaut' END AS form) t
)"""


_STALE = 6 * 3_600_000
STALE = f"""{forms(G, 4, 2)},
msg AS (SELECT run_id, timestamp, event_id, form, timestamp - lag(timestamp) OVER (
  PARTITION BY run_id ORDER BY timestamp, event_id) AS gap FROM fm WHERE changed),
kept AS (SELECT * FROM msg QUALIFY coalesce(max(gap) OVER (
  PARTITION BY run_id ORDER BY timestamp, event_id), 0) < {_STALE}),
ends AS (SELECT run_id, max(timestamp) AS last, arg_max(form, event_id) AS form FROM kept
  GROUP BY run_id),
horizon AS (SELECT max(timestamp) AS h FROM g),
flips AS (SELECT run_id, last, form, unnest(range(1, (h - last) // {_STALE} + 1)) AS i
  FROM ends, horizon),
stale AS (
  SELECT run_id, timestamp AS moment, form, false AS is_stale FROM kept
  UNION ALL
  SELECT run_id, last + i * {_STALE}, CASE WHEN (form = 'juggernaut') = (i % 2 = 0)
    THEN 'juggernaut' ELSE 'skirmisher' END, true FROM flips
)"""

PLAYER = """who AS (SELECT DISTINCT run_id, player_id FROM g)"""

# --- offers --------------------------------------------------------------------------------------


def _effect(effect: tuple) -> str:
    stat, modifier, percentage, duration = effect
    return (f"{{'targetStat': {text(stat)}, 'modifier': {modifier}::DOUBLE, "
            f"'isPercentage': {str(percentage).lower()}, 'duration': {duration}}}")


_BARGAINS = ", ".join(
    f"({text(feature)}, '{polarity}', [{', '.join(_effect(effect) for effect in pool)}])"
    for feature, buffs, debuffs in C.BARGAINS
    for polarity, pool in (("buffs", buffs), ("debuffs", debuffs)))
_NAMES = "[" + ", ".join(text(name) for name in (*_FIELDS, "combo_length")) + "]"


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


TRIGGERS = f"""{G},
t AS (
  SELECT event_id, run_id, player_id, arch, k, coalesce(enc, 'unknown_encounter') AS encounter_id,
    CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'Win' ELSE 'Loss' END END AS prediction,
    CASE WHEN k % 7 <> 0 THEN k % 61 / 100.0::DOUBLE + 0.4::DOUBLE END AS confidence,
    ({_NAMES})[k % 6 + 1] AS primary_feature, ({_NAMES})[k // 6 % 6 + 1] AS secondary_feature,
    event_id % 5 AS reply,
    CASE WHEN k % 7 <> 0 AND k % 2 = 1 THEN 'buffs' ELSE 'debuffs' END AS polarity
  FROM e WHERE event_type = 'seer_encounter_begin'
),
bargains(feature, polarity, pool) AS (VALUES {_BARGAINS})"""


def _round3(value: str) -> str:
    # Through the decimal text of the number: ties are then the same as in decimal rounding.
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(30, 20)), 3) AS DOUBLE)"


def _wording(effect: str) -> str:
    names = "MAP {" + ", ".join(f"{text(a)}: {text(b)}" for a, b in C.STAT_NAMES.items()) + "}"
    return f"""'(' || CASE WHEN {effect}.modifier >= 0 THEN '+' ELSE '' END
  || CASE WHEN {effect}."isPercentage" THEN CAST(trunc({effect}.modifier * 100) AS INT) || '%'
     ELSE CAST(CAST(trunc({effect}.modifier) AS INT) AS VARCHAR) END
  || ' ' || ({names})[{effect}."targetStat"] || ')'"""


def _slot(slot: int, feature: str) -> str:
    scaled = _round3("chosen.modifier * (1 + 1.5::DOUBLE * pow((greatest(confidence, 0.5::DOUBLE) "
                     "- 0.5::DOUBLE) * 2, 2))")
    return f"""
picked_{slot} AS (
  SELECT event_id, confidence,
    pool[{_hash('run_id', 'encounter_id', f"'{slot}'")} % len(pool) + 1] AS chosen
  FROM (SELECT t.*, coalesce(own.pool, dflt.pool) AS pool FROM t LEFT JOIN bargains own ON own.feature = t.{feature} AND own.polarity = t.polarity
  JOIN bargains dflt ON dflt.feature = 'default' AND dflt.polarity = t.polarity)
),
effect_{slot} AS (
  SELECT event_id, {{'targetStat': chosen."targetStat", 'modifier': {scaled},
    'isPercentage': chosen."isPercentage", 'duration': chosen.duration}} AS effect
  FROM picked_{slot}
)"""


def _fallback_rows(kind: str, entries: tuple) -> str:
    return ", ".join(f"('{kind}', {at}, {text(description)}, {_effect(effect)})"
                     for at, (description, effect) in enumerate(entries))


FALLBACK = f"""
fallback(kind, place, description, effect) AS (VALUES
  {_fallback_rows("buffs", C.FALLBACK_BUFFS)}, {_fallback_rows("debuffs", C.FALLBACK_DEBUFFS)}),
drawn AS (
  SELECT event_id, kind, description, effect, row_number() OVER (PARTITION BY event_id ORDER BY
    {_hash('run_id', 'encounter_id', 'place')}, place) AS slot
  FROM t JOIN fallback ON kind = CASE WHEN {_hash('run_id', 'encounter_id', "'pool'")} % 2 = 0
    THEN 'buffs' ELSE 'debuffs' END
),
fb AS (
  SELECT event_id, any_value(kind) AS kind,
    any_value(description) FILTER (slot = 1) AS description_0,
    any_value(description) FILTER (slot = 2) AS description_1,
    any_value(effect) FILTER (slot = 1) AS effect_0,
    any_value(effect) FILTER (slot = 2) AS effect_1
  FROM drawn GROUP BY event_id
)"""

OFFERS = f"""{TRIGGERS}, {_slot(0, 'primary_feature')}, {_slot(1, 'secondary_feature')},
{FALLBACK},
offer AS (
  SELECT t.event_id, t.player_id, t.encounter_id,
    CASE WHEN ok THEN CASE reply WHEN 0 THEN 'Beware.' WHEN 1 THEN 'Alone.'
      ELSE {text(C.REPLY_DIALOGUE)} END ELSE {text(C.FALLBACK_DIALOGUE)} END AS dialogue,
    CASE WHEN ok THEN CASE reply WHEN 0 THEN 'First.' WHEN 1 THEN 'Only.' ELSE 'A choice.' END
      || ' ' || {_wording('e0.effect')} ELSE description_0 END AS description_0,
    CASE WHEN ok THEN CASE reply WHEN 0 THEN 'Second.' WHEN 1 THEN 'Choice 2'
      ELSE 'Another choice.' END || ' ' || {_wording('e1.effect')} ELSE description_1
      END AS description_1,
    CASE WHEN ok THEN e0.effect ELSE effect_0 END AS effect_0,
    CASE WHEN ok THEN e1.effect ELSE effect_1 END AS effect_1,
    CASE WHEN ok THEN polarity ELSE kind END AS kind
  FROM (SELECT *, prediction IS NOT NULL AND reply < 3 AS ok FROM t) t
  JOIN effect_0 e0 USING (event_id) JOIN effect_1 e1 USING (event_id) JOIN fb USING (event_id)
)"""

_REPORT = """dialogue, description_0, description_1, effect_0.modifier AS modifier_0,
  effect_1.modifier AS modifier_1, kind"""


def _prompt(kind: str) -> str:
    return (f"replace(replace({text(C.PROMPTS[kind])}, '{{primary_feature}}', "
            "replace(primary_feature, '_', ' ')), '{secondary_feature}', "
            "replace(secondary_feature, '_', ' '))")


def _choices(slot: int) -> str:
    return f"""{{'description': description_{slot},
  'buffs': CASE WHEN kind = 'buffs' THEN [effect_{slot}] ELSE [] END,
  'debuffs': CASE WHEN kind = 'debuffs' THEN [effect_{slot}] ELSE [] END}}"""


_COMMENT = text("\n".join(C.COMMENT_LINES))
REQUESTS = """
r AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'a weary ' || role END AS personality,
  CASE WHEN conv_id % 7 <> 0 THEN role || '_chars' END AS key,
  conv_id % 9 <> 0 AND conv_id % 7 <> 0 AND text IS NOT NULL AS usable
  FROM conversations)"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"


def oracles() -> dict[str, str]:
    """SQL per query name."""
    g, snap, rec, fights = G, SNAP, RECORDS, FIGHTS
    long_forms = forms(G_LONG)
    snapshot_columns = (f"""event_id, run_id, player_id, event_type, arch AS boss_archetype,
  encounter AS "encounterId", {_FEATURES}""")
    return {
        # --- sources
        "decoded_events": _with(
            g, "SELECT event_id, event_type, timestamp, player_id, run_id FROM g"),
        "valid_and_quarantined": """
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0
  OR event_id % 19 = 0 THEN 'quarantined' ELSE 'valid' END AS status FROM events""",
        "payload_fields": _with(g, f"""
SELECT event_id, CASE WHEN event_type = 'player_movement_event' THEN x END AS move_dx,
  CASE WHEN event_type = 'player_dash_event' THEN y END AS dash_dy,
  CASE WHEN event_type = 'enemy_death_event' THEN x END AS kill_vx,
  CASE WHEN {_TRIGGER} OR {_FIGHT} THEN CASE arch WHEN 'melee' THEN 'Melee'
    WHEN 'final' THEN 'FINAL' ELSE arch END END AS boss_archetype FROM g"""),
        "safe_fields": _with(g, f"""
SELECT event_id, CASE WHEN vec THEN x END AS x, CASE WHEN vec THEN y END AS y,
  CASE WHEN event_type IN ('player_damage_dealt_event', 'damage_taken_event') THEN dmg
    END AS dmg_amount,
  CASE WHEN event_type = 'damage_taken_event' THEN is_elite END AS is_elite_source,
  CASE WHEN event_type = 'player_status_event' THEN hp END AS hp,
  CASE WHEN event_type = 'player_status_event' THEN max_hp END AS max_hp,
  CASE WHEN event_type = 'upgrade_choice' THEN upg END AS chosen_upgrade_id,
  CASE WHEN {_TRIGGER} OR {_FIGHT} THEN arch END AS boss_archetype,
  CASE WHEN {_FIGHT} THEN win END AS win
FROM (SELECT *, event_type IN ('player_movement_event', 'player_dash_event', 'enemy_death_event')
  AS vec FROM g)"""),
        "fight_records": _with(g, f"""
SELECT event_id, run_id, arch AS boss_archetype, win, event_type, enc AS encounter_id FROM g
WHERE {_FIGHT} AND arch <> 'none'"""),
        "landed_by_day": _with(g, """
SELECT strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS dt, event_type, count(*) AS n
FROM g GROUP BY ALL"""),
        "staged_events": _with(g, """
SELECT event_type, timestamp, player_id, run_id,
  strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS dt FROM g"""),
        "record_lake": _with(rec, f"""
SELECT boss_archetype, run_id, "encounterId", weight, {_FEATURES}, upgrade_counts, outcome
FROM rec WHERE event_type = 'boss_fight_completed'"""),
        "seeded_lake": _with(f"{rec}, {SEEDS}", """
SELECT boss_archetype, run_id, "encounterId", weight, total_dashes, outcome FROM rec
WHERE event_type = 'boss_fight_completed'
UNION ALL
SELECT boss_archetype, run_id, "encounterId", weight, total_dashes, outcome FROM seeds"""),
        # --- filters and projections
        "fight_events": _with(g, f"SELECT event_id, event_type FROM g WHERE {_FIGHT}"),
        "usable_fights": _with(
            fights, "SELECT event_id, arch AS boss_archetype FROM f"),
        "guarded_events": _with(g, "SELECT event_id, event_type FROM e"),
        "known_event_rows": _with(g, """
SELECT event_id, run_id, event_type FROM g WHERE event_type <> 'boss_fight_completed'"""),
        "fight_labels": _with(fights, """
SELECT event_id, CASE WHEN win THEN 1 ELSE 0 END AS outcome,
  CASE WHEN event_type = 'boss_fight_completed' THEN 1.0 ELSE 0.1 END::DOUBLE AS weight FROM f"""),
        "enriched_records": _with(rec, f"""
SELECT event_id, run_id, boss_archetype, {_FEATURES}, upgrade_counts, outcome, weight, event_type,
  "encounterId" FROM rec"""),
        "training_rows": _with(rec, f"""
SELECT boss_archetype, {_FEATURES}, upgrade_counts, outcome FROM rec, LATERAL (SELECT unnest(range(
  CASE WHEN event_type = 'boss_fight_completed' THEN 10 ELSE 1 END)))"""),
        "bootstrap_tables": _with(f"{rec}, {SEEDS}", f"""
SELECT boss_archetype, {_FEATURES}, upgrade_counts, outcome FROM (
  SELECT boss_archetype, {', '.join(_FIELDS)}, upgrade_counts, outcome, weight FROM rec
  WHERE event_type = 'boss_fight_completed'
  UNION ALL
  SELECT boss_archetype, {', '.join(_FIELDS)}, '{{}}', outcome, weight FROM seeds
), LATERAL (SELECT unnest(range(CASE WHEN weight >= 1 THEN 10 ELSE 1 END)))"""),
        "weight_parts": _with(fights, """
SELECT event_id, CASE WHEN event_type = 'boss_fight_completed' THEN 'full' ELSE 'light' END AS part
FROM f WHERE win IS NOT NULL"""),
        "type_parts": _with(fights, """
SELECT event_id, CASE WHEN event_type = 'boss_fight_completed' THEN 'boss' ELSE 'elite' END AS part
FROM f"""),
        "feature_summary": _with(rec, "\nUNION ALL\n".join(
            f"SELECT '{name}' AS feature, round(avg({name}), 6) AS mean FROM rec"
            for name in _FIELDS)),
        "labelled_records": _with(
            fights, "SELECT event_id, win::INT AS outcome FROM f WHERE win IS NOT NULL"),
        # --- joins
        "fights_with_final_features": _with(f"""{FINAL},
f AS (SELECT run_id, arch, event_type, win FROM g WHERE {_FIGHT} AND arch <> 'none')""", f"""
SELECT run_id, arch AS boss_archetype, {_FEATURES}, upgrade_counts,
  CASE WHEN win THEN 1 ELSE 0 END AS outcome,
  CASE WHEN event_type = 'boss_fight_completed' THEN 1.0 ELSE 0.1 END::DOUBLE AS weight, event_type
FROM f JOIN vectors USING (run_id)"""),
        "fights_with_snapshots": _with(rec, f"""
SELECT event_id, run_id, boss_archetype, win, snapshot_id, "encounterId", {_FEATURES} FROM rec"""),
        "fights_without_snapshots": _with(fights, f"""
SELECT event_id, run_id, arch AS boss_archetype FROM f WHERE NOT EXISTS (
  SELECT 1 FROM e WHERE e.run_id = f.run_id AND e.{_TRIGGER} AND e.timestamp <= f.timestamp)"""),
        "kill_velocities": _with(
            kills(g), "SELECT event_id, run_id, x, y, vx, vy FROM vel"),
        "triggers_and_features": _with(snap, """
SELECT t.event_id, run_id, t.enc AS encounter_id, t.arch AS boss_archetype, s.player_id,
  s.total_dashes, round(s.avg_hp_percent, 9) AS avg_hp_percent
FROM e t JOIN (SELECT * FROM snap QUALIFY row_number() OVER (
  PARTITION BY run_id ORDER BY timestamp DESC, event_id DESC) = 1) s USING (run_id)
WHERE t.event_type = 'seer_encounter_begin' AND t.enc IS NOT NULL"""),
        "features_of_final_fighters": _with(fights, """
SELECT run_id, count(*) FILTER (event_type = 'player_dash_event') AS total_dashes FROM g
WHERE run_id IN (SELECT run_id FROM f WHERE arch = 'final') GROUP BY run_id"""),
        # --- aggregates
        "dash_counts": _with(g, """
SELECT run_id, count(*) FILTER (event_type = 'player_dash_event') AS total_dashes FROM g
GROUP BY run_id"""),
        "damage_totals": _with(g, """
SELECT run_id,
  round(coalesce(sum(dmg) FILTER (event_type = 'player_damage_dealt_event'), 0), 2)
    AS total_damage_dealt,
  round(coalesce(sum(dmg) FILTER (event_type = 'damage_taken_event'), 0), 2) AS total_damage_taken
FROM g GROUP BY run_id"""),
        "elite_damage_totals": _with(g, """
SELECT run_id, round(coalesce(sum(dmg) FILTER (event_type = 'damage_taken_event' AND is_elite), 0),
  2) AS damage_taken_from_elites FROM g GROUP BY run_id"""),
        "recent_hp": _with(
            FINAL, "SELECT run_id, round(avg_hp, 9) AS avg_hp_percent FROM hp"),
        "recent_hp_long_runs": _with(
            FINAL.replace(G, G_LONG), "SELECT run_id, round(avg_hp, 9) AS avg_hp_percent FROM hp"),
        "upgrade_maps": _with(FINAL, "SELECT run_id, counts AS upgrade_counts FROM maps"),
        "run_players": _with(
            g, f"SELECT run_id, {_FIRST_PLAYER} AS player_id FROM g GROUP BY run_id"),
        "run_players_long_runs": _with(
            G_LONG,
            f"SELECT run_id, {_FIRST_PLAYER} AS player_id FROM g GROUP BY run_id"),
        "run_features": _with(
            FINAL, f"SELECT run_id, player_id, {_FEATURES}, upgrade_counts FROM vectors"),
        "run_features_delivered_twice": _with(
            FINAL, f"SELECT run_id, player_id, {_FEATURES}, upgrade_counts FROM vectors"),
        "ingested_records": _with(INGESTED, """
SELECT event_id, status, count(*) AS n FROM judged GROUP BY event_id, status"""),
        "features_of_ingested_events": _with(f"""{INGESTED},
kept AS (SELECT g.* FROM g JOIN judged USING (event_id)
  WHERE status = 'good' AND NOT (g.{_TRIGGER} AND (g.arch IS NULL OR g.arch = 'none')))""", """
SELECT run_id, count(*) FILTER (event_type = 'player_dash_event') AS total_dashes,
  round(coalesce(sum(dmg) FILTER (event_type = 'player_damage_dealt_event'), 0), 2)
    AS total_damage_dealt,
  round(coalesce(sum(dmg) FILTER (event_type = 'damage_taken_event'), 0), 2) AS total_damage_taken
FROM kept GROUP BY run_id"""),
        "archetypes_seen": _with(fights, "SELECT DISTINCT arch AS boss_archetype FROM f"),
        "record_counts": _with(rec, """
SELECT boss_archetype, count(*) AS enriched, count(*) FILTER (weight = 1) AS persisted,
  sum(CASE WHEN weight = 1 THEN 10 ELSE 1 END)::BIGINT AS oversampled FROM rec
GROUP BY boss_archetype"""),
        # --- point-in-time windows
        "run_snapshots": _with(
            snap, f"SELECT {snapshot_columns}, counts AS upgrade_counts FROM snap"),
        "run_snapshots_long_runs": _with(
            snapshots(G_LONG), f"SELECT {snapshot_columns}, counts AS upgrade_counts FROM snap"),
        "newest_snapshots": _with(snap, f"""
SELECT {snapshot_columns} FROM snap QUALIFY row_number() OVER (
  PARTITION BY run_id ORDER BY timestamp DESC, event_id DESC) = 1"""),
        "upgrades_at_triggers": _with(snap, """
SELECT run_id, event_id, counts AS upgrade_counts FROM snap WHERE counts <> '{}'"""),
        "dash_modes": _with(
            DASHES, "SELECT event_id, run_id, direction, prediction FROM modes"),
        "prediction_changes": _with(predictions(2000), "SELECT * FROM changed"),
        "prediction_changes_daily": _with(predictions(86_400_000), "SELECT * FROM changed"),
        "kill_alignments": _with(kills(g), """
SELECT event_id, run_id, round(cosine, 9) + 0.0 AS cosine, round(alignment, 9) + 0.0 AS alignment FROM al"""),
        "kill_alignments_long_runs": _with(kills(G_LONG), """
SELECT event_id, run_id, round(cosine, 9) + 0.0 AS cosine, round(alignment, 9) + 0.0 AS alignment FROM al"""),
        "enemy_forms": _with(
            forms(g, 4, 2), "SELECT event_id, run_id, form FROM fm WHERE i > 0", True),
        "enemy_forms_long_runs": _with(
            long_forms, "SELECT event_id, run_id, form FROM fm WHERE i > 0", True),
        "enemy_form_changes": _with(
            forms(g), "SELECT event_id, run_id, form FROM fm WHERE changed", True),
        "stale_enemy_forms": _with(STALE, "SELECT run_id, moment, form, is_stale FROM stale", True),
        "z_scores": _with(rec, "SELECT event_id, boss_archetype, " + ", ".join(
            f"round(({name} - avg({name}) OVER w) / stddev_samp({name}) OVER w, 6) + 0.0 AS {name}"
            for name in _FIELDS) + " FROM rec WINDOW w AS (PARTITION BY boss_archetype)"),
        # --- top-k and sets
        "leading_features": _with(f"""{rec},
gaps AS ({' UNION ALL '.join(
            f"SELECT boss_archetype, '{name}' AS feature, avg({name}::DOUBLE) FILTER (outcome = 1)"
            f" - avg({name}::DOUBLE) FILTER (outcome = 0) AS weight FROM rec"
            " GROUP BY boss_archetype" for name in _FIELDS)}),
ranked AS (SELECT *, row_number() OVER (
  PARTITION BY boss_archetype ORDER BY abs(weight) DESC, feature) AS slot
  FROM gaps)""", """
SELECT boss_archetype, coalesce(max(feature) FILTER (slot = 1), 'default') AS feature_1,
  coalesce(max(feature) FILTER (slot = 2), 'default') AS feature_2
FROM ranked GROUP BY boss_archetype"""),
        "scored_by_given_weights": _with(f"""{rec},
figures AS (SELECT boss_archetype AS model, {', '.join(
            f"avg({name}::DOUBLE) AS mean_{name}, stddev_pop({name}::DOUBLE) AS sd_{name}"
            for name in _FIELDS)} FROM rec WHERE boss_archetype <> 'final' GROUP BY 1),
margins AS (SELECT event_id, boss_archetype, model, 0.1::DOUBLE + {' + '.join(
            f"({0.5 - 0.3 * at})::DOUBLE * CASE WHEN sd_{name} <> 0"
            f" THEN ({name} - mean_{name}) / sd_{name} ELSE 0 END"
            for at, name in enumerate(_FIELDS))} AS margin
  FROM rec LEFT JOIN figures ON model = boss_archetype),
chances AS (SELECT *, CASE WHEN model IS NOT NULL THEN 1 / (1 + exp(-margin)) END AS win FROM margins)""", f"""
SELECT event_id, boss_archetype, CASE WHEN win > 0.5 THEN 'Win' WHEN win IS NOT NULL THEN 'Loss' END
  AS prediction, round(win, 6) AS win, round(greatest(win, 1 - win), 6) AS confidence,
  CASE WHEN model IS NOT NULL THEN '{_FIELDS[-1]}' END AS primary_feature,
  CASE WHEN model IS NOT NULL THEN '{_FIELDS[0]}' END AS secondary_feature FROM chances"""),
        "fit_optimality": _with(rec, f"""
SELECT DISTINCT boss_archetype, feature, true AS flat, true AS better
FROM rec, (SELECT unnest({list(_FIELDS)}) AS feature)"""),
        "newest_dashes": _with(g, """
SELECT event_id, run_id FROM g WHERE event_type = 'player_dash_event' QUALIFY row_number() OVER (
  PARTITION BY run_id ORDER BY timestamp DESC, event_id DESC) <= 10"""),
        "oversampled_records": _with(fights, """
SELECT event_id, event_type, CASE WHEN event_type = 'boss_fight_completed' THEN 1.0 ELSE 0.1
  END::DOUBLE AS weight FROM f, LATERAL (SELECT unnest(range(
  CASE WHEN event_type = 'boss_fight_completed' THEN 10 ELSE 1 END)))"""),
        "united_fights": _with(fights, """
SELECT event_id, event_type FROM f UNION ALL
SELECT event_id, event_type FROM f WHERE event_type = 'boss_fight_completed'"""),
        # --- scalar expressions
        "dash_directions": _with(f"{g}, d AS (SELECT event_id, {_DIRECTION} AS direction FROM g "
                                 "WHERE event_type = 'player_dash_event')", """
SELECT event_id, direction, CASE direction WHEN 'left' THEN -1 WHEN 'right' THEN 1 ELSE 0 END AS dx,
  CASE direction WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END AS dy FROM d"""),
        "hp_ratios": _with(g, """
SELECT event_id, round(CASE WHEN max_hp > 0 THEN hp / max_hp END, 9) AS ratio FROM g
WHERE event_type = 'player_status_event'"""),
        "encounter_ids": _with(g, f"""
SELECT event_id, coalesce(enc, sha256(run_id || timestamp)) AS encounter_id FROM e
WHERE {_TRIGGER}"""),
        "form_messages": _with(f"{forms(g)}, {PLAYER}", """
SELECT event_id, to_json({'message_type': 'form_adaptation', 'payload': to_json(
  {'playerId': player_id, 'adaptation_type': form})::VARCHAR})::VARCHAR AS value
FROM fm JOIN who USING (run_id) WHERE changed""", True),
        "prediction_messages": _with(f"{predictions(2000)}, {PLAYER}", """
SELECT run_id, moment, to_json({'message_type': 'vexer_prediction_update', 'payload': to_json(
  {'playerId': player_id, 'predicted_direction': {
    'dx': CASE prediction WHEN 'left' THEN -1 WHEN 'right' THEN 1 ELSE 0 END::DOUBLE,
    'dy': CASE prediction WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END::DOUBLE}})::VARCHAR
  })::VARCHAR AS value FROM changed JOIN who USING (run_id)"""),
        "trigger_messages": _with(g, """
SELECT event_id, to_json({'run_id': run_id, 'encounter_id': coalesce(enc, 'unknown_encounter'),
  'boss_archetype': arch})::VARCHAR AS value FROM e WHERE event_type = 'seer_encounter_begin'"""),
        # --- offers
        "bargain_offers": _with(OFFERS, f"SELECT event_id, {_REPORT} FROM offer"),
        "fallback_offers": _with(f"{TRIGGERS}, {FALLBACK}", f"""
SELECT event_id, {text(C.FALLBACK_DIALOGUE)} AS dialogue, description_0, description_1,
  effect_0.modifier AS modifier_0, effect_1.modifier AS modifier_1, kind FROM fb"""),
        "result_messages": _with(OFFERS, f"""
SELECT event_id, to_json({{'message_type': 'seer_result_update', 'payload': to_json(
  {{'playerId': player_id, 'encounterId': encounter_id, 'dialogue': dialogue,
    'choices': [{_choices(0)}, {_choices(1)}]}})::VARCHAR}})::VARCHAR AS value FROM offer"""),
        "bargain_pools": _with(TRIGGERS, """
SELECT event_id, t.polarity, len(coalesce(own.pool, dflt.pool))::INT AS n,
  coalesce(own.pool, dflt.pool)[1]."targetStat" AS first_stat
FROM t LEFT JOIN bargains own ON own.feature = t.primary_feature AND own.polarity = t.polarity
JOIN bargains dflt ON dflt.feature = 'default' AND dflt.polarity = t.polarity"""),
        "chosen_effects": _with(f"""{TRIGGERS}, {_slot(0, 'primary_feature')}""", f"""
SELECT event_id, effect."targetStat" AS "targetStat", effect.modifier AS modifier,
  {_wording('effect')} AS wording FROM effect_0 WHERE effect.modifier IS NOT NULL
UNION ALL
SELECT event_id, effect."targetStat", NULL, NULL FROM effect_0 WHERE effect.modifier IS NULL"""),
        "bargain_prompts": _with(TRIGGERS, f"""
SELECT event_id, CASE prediction WHEN 'Win' THEN {_prompt('win')} WHEN 'Loss' THEN
  {_prompt('loss')} END AS prompt FROM t"""),
        "parsed_replies": _with(TRIGGERS, f"""
SELECT event_id, CASE reply WHEN 0 THEN 'Beware.' WHEN 1 THEN 'Alone.'
    WHEN 2 THEN {text(C.REPLY_DIALOGUE)} END AS dialogue,
  CASE reply WHEN 0 THEN 'Second.' WHEN 1 THEN 'Choice 2' WHEN 2 THEN 'Another choice.'
    END AS second FROM t"""),
        # --- feature cache
        "cached_features": _with(snap, f"""
SELECT event_id, run_id, player_id, arch AS boss_archetype, encounter AS "encounterId", {_FEATURES}
FROM snap QUALIFY row_number() OVER (
  PARTITION BY run_id ORDER BY timestamp DESC, event_id DESC) = 1"""),
        "cached_features_of_final_fighters": _with(snap, f"""
SELECT event_id, run_id, player_id, arch AS boss_archetype, encounter AS "encounterId", {_FEATURES}
FROM snap WHERE run_id IN (SELECT run_id FROM g WHERE {_FIGHT} AND arch = 'final')
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY timestamp DESC, event_id DESC) = 1"""),
        # --- commentary
        "comment_prompts": _with(REQUESTS, f"""
SELECT conv_id, turn, replace(replace(replace({_COMMENT}, '{{personality}}',
  coalesce(personality, {text(C.DEFAULT_PERSONALITY)})), '{{key}}', key),
  '{{value}}', length(text)::VARCHAR) AS prompt FROM r WHERE usable"""),
        "rejected_requests": _with(REQUESTS, "SELECT conv_id, turn FROM r WHERE NOT usable"),
        "clean_comments": _with(REQUESTS, f"""
SELECT conv_id, turn, md5(CASE WHEN turn % 3 <> 0 AND text IS NOT NULL
  THEN replace(regexp_replace('  "' || text || '" ', '^\\s+|\\s+$', '', 'g'), '"', '')
  ELSE {text(C.COMMENT_FALLBACK)} END) AS comment_md5 FROM r"""),
        # --- streams
        "streamed_snapshots": _with(snap, f"""
SELECT event_id, run_id, player_id, arch AS boss_archetype, encounter AS "encounterId", {_FEATURES},
  counts AS upgrade_counts FROM snap"""),
        "streamed_fights_with_snapshots": _with(rec, f"""
SELECT event_id, run_id, boss_archetype, win, snapshot_id, "encounterId", {_FEATURES} FROM rec"""),
        "streamed_training_rows": _with(rec, f"""
SELECT boss_archetype, {_FEATURES}, upgrade_counts, outcome FROM rec, LATERAL (SELECT unnest(range(
  CASE WHEN event_type = 'boss_fight_completed' THEN 10 ELSE 1 END)))"""),
        "audited_enrichment": _with(f"""{rec}, every AS (
SELECT count(*) AS n FROM g WHERE {_FIGHT} AND arch IS NOT NULL AND arch <> 'none')""", """
SELECT any_value(n) AS loaded, count(*) AS enriched, any_value(n) - count(*) AS expired,
  sum(CASE WHEN weight = 1 THEN 10 ELSE 1 END)::BIGINT AS oversampled,
  count(*) FILTER (weight = 1) AS persisted FROM rec, every"""),
        "streamed_forms": _with(STALE, "SELECT run_id, moment, form FROM stale", True),
        "streamed_predictions": _with(predictions(2000) + """,
horizon AS (SELECT max(timestamp) AS h FROM g)""",
                                      "SELECT changed.* FROM changed, horizon WHERE moment <= h"),
    }
