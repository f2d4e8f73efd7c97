"""Names, thresholds, texts and tables that results depend on."""

# --- fixed values: event types -----------------------------------------------------------------
MOVEMENT = "player_movement_event"
DASH = "player_dash_event"
KILL = "enemy_death_event"
DAMAGE_DEALT = "player_damage_dealt_event"
DAMAGE_TAKEN = "damage_taken_event"
STATUS = "player_status_event"
UPGRADE = "upgrade_choice"
ENCOUNTER = "seer_encounter_begin"
ELITE_DONE = "elite_fight_completed"
BOSS_DONE = "boss_fight_completed"
SESSION_START = "play_session_started"

PROFILE_EVENTS = (
    MOVEMENT, DASH, KILL, DAMAGE_DEALT, DAMAGE_TAKEN, STATUS, UPGRADE, ENCOUNTER, ELITE_DONE,
)
TRIGGER_EVENTS = (ENCOUNTER, ELITE_DONE)
FIGHT_EVENTS = (BOSS_DONE, ELITE_DONE)

# --- fixed values: defaults of missing payload fields --------------------------------------------
NO_ARCHETYPE = "none"
DEFAULT_UPGRADE = "unknown"
DEFAULT_ENCOUNTER = "unknown_encounter"
DEFAULT_ARCHETYPE = "melee"

# --- fixed values: adaptation thresholds ---------------------------------------------------------
JUGGERNAUT = "juggernaut"
SKIRMISHER = "skirmisher"
NO_PREDICTION = "none"
HP_HISTORY = 100
DASH_HISTORY = 10
KILL_HISTORY = 20
KILL_MIN = 5
JUGGERNAUT_BELOW = -0.2
SKIRMISHER_ABOVE = 0.6
PREDICTION_TICK_MS = 2000
#: A run without events for a day has ended.
IDLE_MS = 86_400_000
STALE_MS = 5000
GRACE_MS = 5000

# --- fixed values: training records --------------------------------------------------------------
ARCHETYPES = ("melee", "ranged", "final")
BOSS_WEIGHT = 1.0
ELITE_WEIGHT = 0.1
OVERSAMPLE = 10
TABLE_SUFFIX = "_training_data"
NON_FEATURES = ("run_id", "encounterId", "player_id", "outcome", "weight", "upgrade_counts")

# archetype, run_id, encounterId, weight, dashes, dealt, taken, taken from elites, avg hp, outcome
SEED_ROWS = (
    ("melee", "seed_run_melee_loss", "seed_encounter", 0.1, 5, 100.0, 150.0, 0.0, 0.3, 0),
    ("melee", "seed_run_melee_win", "seed_encounter", 0.1, 20, 500.0, 50.0, 0.0, 0.8, 1),
    ("ranged", "seed_run_ranged_loss", "seed_encounter", 0.1, 10, 200.0, 120.0, 0.0, 0.4, 0),
    ("ranged", "seed_run_ranged_win", "seed_encounter", 0.1, 30, 600.0, 40.0, 0.0, 0.9, 1),
    ("final", "seed_run_final_loss", "seed_encounter", 1.0, 15, 400.0, 200.0, 0.0, 0.2, 0),
    ("final", "seed_run_final_win", "seed_encounter", 1.0, 40, 1000.0, 100.0, 0.0, 0.7, 1),
)

# --- fixed values: message types and topics -------------------------------------------------------
FORM_MESSAGE = "form_adaptation"
PREDICTION_MESSAGE = "vexer_prediction_update"
RESULT_MESSAGE = "seer_result_update"
EVENTS_TOPIC = "gameplay_events"
PARAMS_TOPIC = "adaptive_params"
TRIGGERS_TOPIC = "seer_triggers"
PREDICTIONS_TOPIC = "vexer_prediction_updates"
RESULTS_TOPIC = "seer_results"

# --- fixed values: model and offers ---------------------------------------------------------------
CONFIDENCE_SCALING = 1.5
DEFAULT_CONFIDENCE = 0.5
DEFAULT_FEATURE = "default"

STAT_NAMES = {
    "DashCooldown": "Dash Cooldown",
    "MoveSpeed": "Move Speed",
    "AttackDamage": "Attack Damage",
    "MaxHealth": "Max HP",
    "Armor": "Armor",
    "AttackSpeed": "Attack Speed",
}

# feature, buffs, debuffs; an effect is (stat, modifier, is percentage, duration in seconds)
BARGAINS = (
    ("total_dashes",
     (("DashCooldown", -0.15, True, 180), ("MoveSpeed", 0.10, True, 180)),
     (("DashCooldown", 0.20, True, 180), ("MoveSpeed", -0.10, True, 180))),
    ("total_damage_dealt",
     (("AttackDamage", 0.15, True, 180),),
     (("AttackDamage", -0.20, True, 180),)),
    ("total_damage_taken",
     (("MaxHealth", 0.25, True, 180), ("Armor", 20.0, False, 180)),
     (("MaxHealth", -0.20, True, 180), ("Armor", -15.0, False, 180))),
    ("damage_taken_from_elites",
     (("Armor", 30.0, False, 180),),
     (("AttackSpeed", -0.15, True, 180),)),
    ("avg_hp_percent",
     (("MaxHealth", 0.20, True, 180),),
     (("MoveSpeed", -0.15, True, 180),)),
    ("default",
     (("AttackSpeed", 0.10, True, 180),),
     (("Armor", -10.0, False, 180),)),
)

# description, effect; a buff choice carries its effect as buff, a debuff choice as debuff
FALLBACK_BUFFS = (
    ("A sliver of fortitude. (+20% Max HP)", ("MaxHealth", 0.20, True, 180)),
    ("A fleeting burst of speed. (+10% Move Speed)", ("MoveSpeed", 0.10, True, 180)),
    ("A moment of clarity. (-15% Dash Cooldown)", ("DashCooldown", -0.15, True, 180)),
    ("A surge of inner power. (+10% Attack Damage)", ("AttackDamage", 0.10, True, 180)),
)
FALLBACK_DEBUFFS = (
    ("A true test of skill. (-15% Attack Damage)", ("AttackDamage", -0.15, True, 180)),
    ("An unexpected burden. (+20% Dash Cooldown)", ("DashCooldown", 0.20, True, 180)),
    ("A heavy heart. (-15% Move Speed)", ("MoveSpeed", -0.15, True, 180)),
    ("A crack in your defenses. (-15 Armor)", ("Armor", -15.0, False, 180)),
)
FALLBACK_DIALOGUE = (
    "The visions are... unclear. The threads of fate refuse to be read. "
    "I can offer you a choice, but its nature is as murky as the future itself."
)

REPLY_DIALOGUE = "The vision is complete."
REPLY_DESCRIPTIONS = ("A choice.", "Another choice.")

PROMPTS = {
    "win": (
        "You are a cryptic, all-knowing Seer. A player is about to face a boss. "
        "An oracle has predicted they will WIN.\n"
        "The primary reason for this prediction is their performance related to: "
        "'{primary_feature}'.\n"
        "The secondary reason is: '{secondary_feature}'.\n"
        "\n"
        "Generate a JSON object with two keys: \"dialogue\" and \"bargain_descriptions\".\n"
        "- \"dialogue\": A short, 2-sentence prophecy that sounds confident and hints at why "
        "they will win, based on the primary feature. It must lead into offering a challenge.\n"
        "- \"bargain_descriptions\": A list of two strings. The first string should describe a "
        "challenge (a debuff) related to the primary feature. The second string should describe "
        "a challenge related to the secondary feature.\n"
    ),
    "loss": (
        "You are a cryptic, all-knowing Seer. A player is about to face a boss. "
        "An oracle has predicted they will LOSE.\n"
        "The primary reason for this prediction is their performance related to: "
        "'{primary_feature}'.\n"
        "The secondary reason is: '{secondary_feature}'.\n"
        "\n"
        "Generate a JSON object with two keys: \"dialogue\" and \"bargain_descriptions\".\n"
        "- \"dialogue\": A short, 2-sentence prophecy that sounds ominous and hints at why "
        "they will lose, based on the primary feature. It must lead into offering a boon.\n"
        "- \"bargain_descriptions\": A list of two strings. The first string should describe a "
        "helpful boon (a buff) related to the primary feature. The second string should describe "
        "a boon related to the secondary feature.\n"
    ),
}

DEFAULT_PERSONALITY = "a generic video game character"
COMMENT_FALLBACK = "I... have nothing to say."
COMMENT_LINES = (
    "You are a video game NPC with this personality: '{personality}'.",
    "Based on the following single fact about a player, provide a short, flavorful, "
    "in-character comment (2-3 sentences max).",
    "Feel free to state the fact literally or allude to it naturally in your comment.",
    "For example, if the fact is 'enemies_killed_total: 50', you might say 'You fought with the "
    "fury of a wild lion! So much carnage in such a short time.' to naturally allude to it",
    "Fact to comment on: '{key}: {value}'",
)
