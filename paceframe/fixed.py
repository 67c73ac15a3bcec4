"""Thresholds, weights, column names and file-name patterns."""

from __future__ import annotations

# --- fixed values: workload-ratio bands (upper bound, risk) and zone names ---
ACWR_LOW = 0.8
ACWR_RISK_BELOW_LOW = 25.0
ACWR_RISK = [(1.0, 20.0), (1.3, 35.0), (1.5, 65.0), (1.8, 85.0)]
ACWR_RISK_ABOVE = 100.0
ACWR_ZONES = [(1.3, "sweet_spot"), (1.5, "elevated_progression")]
ACWR_ZONE_BELOW_LOW = "undertraining"
ACWR_ZONE_ABOVE = "danger_zone"
ACWR_SPIKE_ZONES = ["elevated_progression", "danger_zone"]

# --- fixed values: running-speed bands in m/s ---
SPEED_RISK = [(2.5, 15.0), (3.5, 40.0), (4.5, 75.0)]
SPEED_RISK_ABOVE = 95.0
SPEED_BANDS = [(2.5, "low_magnitude"), (3.5, "moderate"), (4.5, "elevated")]
SPEED_BAND_ABOVE = "high_magnitude"
HARD_SESSION_SPEED = 3.5
HARD_SESSION_KM = 5.0

# --- fixed values: weekly running volume in km ---
VOLUME_RISK = [(15.0, 10.0), (30.0, 25.0), (50.0, 40.0), (70.0, 55.0), (90.0, 70.0), (110.0, 82.0), (130.0, 92.0)]
VOLUME_RISK_ABOVE = 100.0

# --- fixed values: training monotony and strain ---
MONOTONY_RISK = [(1.5, 20.0), (2.0, 40.0), (2.5, 65.0)]
MONOTONY_RISK_ABOVE = 85.0
MONOTONY_ELEVATED = 2.0
MONOTONY_CAP = 10.0
STRAIN_REFERENCE = 250000.0

# --- fixed values: readiness ladder ---
READINESS_RISK = [(20.0, 100.0), (35.0, 80.0), (50.0, 55.0)]

# --- fixed values: levels ---
LEVEL_HIGH = 70.0
LEVEL_MODERATE = 45.0
STATE_HIGH = 65.0
STATE_MODERATE = 45.0

# --- fixed values: composite running load ---
LOAD_DISTANCE = 1.0
LOAD_SPEED_DURATION = 0.45
LOAD_ELEVATION = 1.0
LOAD_AEROBIC = 2500.0
LOAD_ANAEROBIC = 5000.0
LOAD_HR_DURATION = 30.0
MAX_RUN_SPEED = 6.5
MAX_SPEED_SHARE = 0.85

# --- fixed values: windows and decay ---
BASELINE_DAYS = 28
MIN_HISTORY = 7
BONE_DECAY = 0.91
RECOVERY_DECAY = 0.86
CARRYOVER_ROWS = 21
ANOMALY_ROWS = 28

# --- fixed values: frontier blend ---
FRONTIER_WEIGHTS = (0.40, 0.35, 0.25)
NOVELTY_BASE_WEIGHT = 0.55
NOVELTY_CONTRAST_WEIGHT = 0.45
NORMALISE_QUANTILE = 0.95

# --- fixed values: sport families, first match wins; tokens are substrings ---
SPORT_TOKENS = [
    ("running", ["run"]),
    ("cycling", ["cycl", "bik"]),
    ("hiking", ["hik", "walk"]),
    ("swimming", ["swim"]),
]
SPORT_FAMILIES = ["running", "cycling", "hiking", "swimming", "other"]

# --- fixed values: JSON family by file name, first match wins ---
JSON_FAMILIES = [
    ("contains", "summarizedActivities", "activity_summary"),
    ("contains", "sleepData", "sleep"),
    ("starts", "UDSFile", "wellness"),
    ("starts", "HydrationLogFile", "hydration"),
    ("starts", "TrainingReadinessDTO", "readiness"),
    ("starts", "MetricsAcuteTrainingLoad", "load"),
    ("starts", "MetricsMaxMetData", "fitness"),
    ("starts", "TrainingHistory", "training_history"),
    ("starts", "EnduranceScore", "endurance"),
    ("starts", "HillScore", "hill"),
    ("starts", "RunRacePredictions", "race_prediction"),
    ("starts", "MetricsHeatAltitudeAcclimation", "acclimation"),
    ("contains", "healthStatusData", "health_status"),
]
JSON_FAMILY_OTHER = "generic_json"
FILE_SUFFIXES = ["fit", "csv", "json", "tcx", "xml"]

# --- fixed values: source priority for de-duplication ---
SOURCE_PRIORITY = [("contains", "summarizedactivities", 3), ("ends", ".tcx", 2), ("ends", ".fit", 1)]

# --- fixed values: activity columns ---
ACTIVITY_NUMERIC = [
    "activity_duration_seconds",
    "activity_moving_duration_seconds",
    "activity_elapsed_duration_seconds",
    "activity_distance_m",
    "activity_calories",
    "activity_avg_hr",
    "activity_max_hr",
    "activity_avg_speed",
    "activity_max_speed",
    "activity_elevation_gain",
    "activity_elevation_loss",
    "activity_steps",
    "activity_aerobic_training_effect",
    "activity_anaerobic_training_effect",
    "activity_vo2_max",
    "activity_training_load",
]
DAILY_SUM_COLUMNS = [
    "activity_duration_seconds",
    "activity_moving_duration_seconds",
    "activity_elapsed_duration_seconds",
    "activity_distance_m",
    "activity_calories",
    "activity_steps",
    "activity_training_load",
]
DAILY_MAX_COLUMNS = ["activity_max_hr"]
FAMILY_SUM_COLUMNS = DAILY_SUM_COLUMNS + ["activity_elevation_gain", "activity_elevation_loss"]
FAMILY_MEAN_COLUMNS = [
    "activity_avg_hr",
    "activity_max_hr",
    "activity_avg_speed",
    "activity_max_speed",
    "activity_aerobic_training_effect",
    "activity_anaerobic_training_effect",
]

# --- fixed values: weighted load per sport (running, hiking, cycling) ---
WEIGHTED_LOADS = [
    ("impact_weighted_duration_seconds", "duration_seconds", (1.0, 0.65, 0.15)),
    ("impact_weighted_distance_m", "distance_m", (1.0, 0.6, 0.05)),
    ("fatigue_weighted_duration_seconds", "duration_seconds", (1.0, 0.85, 0.8)),
]

# --- fixed values: canonical names and their source candidates, first existing wins ---
CANONICAL = {
    "readiness": ["readiness_score"],
    "hrv": ["readiness_hrvWeeklyAverage"],
    "resting_hr": ["wellness_restingHeartRate", "wellness_currentDayRestingHeartRate"],
    "sleep": ["sleep_total_seconds", "sleep_total_in_bed_seconds"],
    "body_battery_charged": ["wellness_bodyBattery_chargedValue"],
    "body_battery_drained": ["wellness_bodyBattery_drainedValue"],
    "load": ["load_dailyTrainingLoadAcute", "readiness_acuteLoad", "activity_training_load"],
    "duration": ["activity_duration_seconds"],
    "distance": ["activity_distance_m"],
    "activity_count": ["activity_count"],
    "running_duration": ["running_duration_seconds"],
    "running_distance": ["running_distance_m"],
    "cycling_duration": ["cycling_duration_seconds"],
    "cycling_distance": ["cycling_distance_m"],
    "hiking_duration": ["hiking_duration_seconds"],
    "hiking_distance": ["hiking_distance_m"],
    "impact_duration": ["impact_weighted_duration_seconds"],
    "impact_distance": ["impact_weighted_distance_m"],
    "fatigue_duration": ["fatigue_weighted_duration_seconds"],
}
CANONICAL_RUNNING = {
    "running_avg_speed": ["running_avg_speed"],
    "running_max_speed": ["running_max_speed"],
    "running_avg_hr": ["running_avg_hr"],
    "running_max_hr": ["running_max_hr"],
    "running_elevation_gain": ["running_elevation_gain"],
    "running_aerobic_te": ["running_aerobic_training_effect"],
    "running_anaerobic_te": ["running_anaerobic_training_effect"],
    "running_activity_count": ["running_activity_count"],
}
CANONICAL_CONTEXT = {
    "readiness": ["readiness", "readiness_score"],
    "load": ["load", "load_dailyTrainingLoadAcute", "activity_training_load", "readiness_acuteLoad"],
    "hrv": ["hrv", "readiness_hrvWeeklyAverage"],
    "resting_hr": ["resting_hr", "wellness_restingHeartRate", "wellness_currentDayRestingHeartRate"],
}
CONTEXT_COLUMNS = [
    "readiness",
    "load",
    "hrv",
    "resting_hr",
    "activity_count",
    "activity_duration_seconds",
    "activity_distance_m",
    "activity_calories",
    "activity_avg_hr",
    "activity_max_hr",
    "activity_steps",
]

# --- fixed values: feature display names ---
FEATURE_LABELS = {
    "running_distance_m": "Running distance",
    "running_duration_seconds": "Running duration",
    "running_avg_hr": "Running heart rate",
    "running_max_hr": "Running max HR",
    "cycling_distance_m": "Cycling distance",
    "cycling_duration_seconds": "Cycling duration",
    "load_dailyTrainingLoadAcute": "Acute training load",
    "load_dailyAcuteChronicWorkloadRatio": "ACWR",
    "readiness_score": "Readiness",
    "readiness_hrvWeeklyAverage": "HRV",
    "wellness_restingHeartRate": "Resting HR",
    "sleep_total_seconds": "Sleep duration",
    "wellness_bodyBattery_chargedValue": "Body battery charged",
    "wellness_bodyBattery_drainedValue": "Body battery drained",
    "activity_training_load": "Activity training load",
    "impact_weighted_duration_seconds": "Impact duration",
    "fatigue_weighted_duration_seconds": "Fatigue duration",
}

# --- fixed values: model settings ---
WINDOW_ROWS = 28
TRAIN_FRACTION = 0.7
VALIDATION_FRACTION = 0.15
RIDGE_ALPHA = 10.0
EMBEDDING_DIM = 16

# --- fixed values: period rules ---
RISK_PERIOD_THRESHOLD = 50.0
RISK_PERIOD_MIN_DAYS = 3
RISK_PERIOD_MAX_GAP = 1
BONE_PERIOD_MAX_GAP = 4
BONE_PERIOD_MIN_DAYS = 5
BONE_PERIOD_MIN_PEAK = 60.0
BONE_PERIOD_MAX_SPAN = 49
PERIOD_GRACE_DAYS = 7
LOOKBACK_DAYS = 56
STATE_THRESHOLDS = [45.0, 65.0]
SCENARIO_FACTORS = [0.85, 0.55]
TARGET_LITERATURE_SCORE = 70.0
