"""Model parameters.

Everything in this module is a fixed value: lists, tables and coefficients that
results depend on.  Operators take them as default arguments, so a study can
pass its own tables instead.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Leisure subtypes, categories, keywords
# --------------------------------------------------------------------------
SUBTYPES = (
    "food_takeout", "food_dine_in", "live_music", "workout_or_run",
    "cafe_friend", "museum", "park",
)

SUBTYPE_CATEGORIES = {
    "food_takeout": ("food_takeout", "restaurant", "food"),
    "food_dine_in": ("restaurant", "food"),
    "live_music": ("live_music", "concert_venue", "music_event"),
    "workout_or_run": ("fitness_studio", "gym", "running_route"),
    "cafe_friend": ("cafe",),
    "museum": ("museum",),
    "park": ("park",),
}

SUBTYPE_KEYWORDS = {
    "food_takeout": ("takeout", "quick", "food"),
    "food_dine_in": ("restaurant", "dinner", "food"),
    "live_music": ("live", "concert", "music"),
    "workout_or_run": ("workout", "fitness", "run"),
    "cafe_friend": ("cafe", "coffee", "friends"),
    "museum": ("museum", "art", "culture"),
    "park": ("park", "green", "outdoor"),
}

CATEGORY_KEYWORDS = {
    "food_takeout": ("takeout", "quick", "food"),
    "restaurant": ("restaurant", "dinner", "food"),
    "cafe": ("cafe", "coffee", "friends"),
    "live_music": ("live", "concert", "music"),
    "concert_venue": ("music", "venue", "concert"),
    "music_event": ("music", "event", "live"),
    "fitness_studio": ("fitness", "workout", "class"),
    "gym": ("gym", "strength", "workout"),
    "running_route": ("run", "outdoor", "fitness"),
    "museum": ("museum", "art", "culture"),
    "park": ("park", "green", "outdoor"),
}

# Per subtype (base activity utility, duration range, delay range,
# opening window), minutes from midnight.
SEGMENTS = {
    "food_takeout": dict(utility=0.35, duration=(25, 75), delay=(10, 45), window=(660, 1320)),
    "food_dine_in": dict(utility=0.55, duration=(60, 150), delay=(20, 75), window=(660, 1380)),
    "live_music": dict(utility=0.70, duration=(90, 210), delay=(45, 150), window=(1080, 1410)),
    "workout_or_run": dict(utility=0.60, duration=(40, 110), delay=(10, 60), window=(360, 1320)),
    "cafe_friend": dict(utility=0.55, duration=(45, 135), delay=(15, 90), window=(480, 1200)),
    "museum": dict(utility=0.65, duration=(75, 180), delay=(25, 120), window=(600, 1080)),
    "park": dict(utility=0.50, duration=(40, 140), delay=(10, 80), window=(360, 1260)),
}
DEFAULT_WINDOW = (540, 1380)

# --------------------------------------------------------------------------
# Place classification
# --------------------------------------------------------------------------
NAICS_CATEGORY = {
    "722511": "restaurant",
    "722513": "food_takeout",
    "722514": "restaurant",
    "722515": "cafe",
    "722410": "restaurant",
    "712110": "museum",
    "712120": "museum",
    "712130": "park",
    "712190": "park",
    "713940": "fitness_studio",
    "711110": "live_music",
    "711130": "live_music",
    "711310": "concert_venue",
}

TEXT_CATEGORY = (
    ("coffee", "cafe"), ("snack and nonalcoholic", "cafe"),
    ("nature park", "park"), ("botanical", "park"), ("zoos", "park"),
    ("museum", "museum"), ("historical site", "museum"),
    ("fitness", "fitness_studio"), ("recreational sports", "fitness_studio"),
    ("musical", "live_music"), ("performing arts", "live_music"),
    ("theater", "live_music"), ("promoters", "concert_venue"),
    ("drinking place", "restaurant"), ("full-service restaurant", "restaurant"),
    ("limited-service restaurant", "food_takeout"), ("restaurant", "restaurant"),
)

# Box of the place filter, as (south, west, north, east).
POI_BBOX = (40.47, -74.30, 40.93, -73.68)
POI_CAP_SEED = 20240608

# --------------------------------------------------------------------------
# Travel modes, in choice order
# --------------------------------------------------------------------------
MODES = ("walk", "bike", "transit", "car")
MODE_TABLE = {
    "walk": dict(speed=4.8, per_km=0.0, fixed=0.0, g_km=0.0, wait=0.0, comfort=0.2,
                 status=0.2, enjoyment=0.5, community=0.05),
    "bike": dict(speed=14.0, per_km=0.02, fixed=0.0, g_km=0.0, wait=0.0, comfort=0.4,
                 status=0.3, enjoyment=0.6, community=0.10),
    "transit": dict(speed=22.0, per_km=0.12, fixed=1.2, g_km=30.0, wait=7.0, comfort=0.45,
                    status=0.4, enjoyment=0.3, community=0.08),
    "car": dict(speed=30.0, per_km=0.28, fixed=1.0, g_km=180.0, wait=1.0, comfort=0.7,
                status=0.9, enjoyment=0.2, community=-0.02),
}
MODE_TASTE = {
    "food_takeout": {"bike": 0.05, "walk": 0.03, "car": -0.02},
    "food_dine_in": {"transit": 0.05},
    "live_music": {"transit": 0.10, "walk": -0.03},
    "workout_or_run": {"walk": 0.18, "bike": 0.14, "car": -0.10},
    "cafe_friend": {"walk": 0.10, "bike": 0.07, "car": -0.04},
    "museum": {"transit": 0.09, "walk": 0.06, "car": -0.03},
    "park": {"walk": 0.15, "bike": 0.10, "car": -0.08},
}
WEATHER_SPEED = {
    "rain": {"walk": 0.75, "bike": 0.75, "transit": 0.9, "car": 0.9},
    "heat": {"walk": 0.80, "bike": 0.80, "transit": 1.0, "car": 1.0},
    "fair": {"walk": 1.0, "bike": 1.0, "transit": 1.0, "car": 1.0},
}
MODE_COLOR = {"car": (230, 80, 60), "walk": (80, 170, 90), "bike": (240, 180, 40), "transit": (70, 130, 220)}
STATE_COLOR = {"home": (80, 170, 90), "work": (240, 150, 40), "leisure": (160, 90, 210), "in_transit": (230, 80, 60)}

AVAILABILITY = dict(carshare_min_km=1.5, no_car_min_km=3.0, bike_max_km=12.0, bike_max_age=75,
                    walk_min_per_km=12.0, walk_ada_km=1.0, walk_floor_km=0.5, walk_max_age=85)
CONGESTION = dict(alpha=0.15, beta=4, crowd=0.25, crowd_exp=2, price_base=2.0, price_km=0.15)
CAPACITY = dict(road_mult=1.8, road_floor=60, transit_mult=2.5, transit_floor=120)
UTILITY = dict(cost_denominator=8.0, derived=0.05, derived_div=10.0, intrinsic_div=30.0, escape_km=5.0,
               escape_cap=1.5, green_boost=1.25, emissions_div=1000.0, act_intrinsic=0.30, act_escape=0.15)
REFERENCE_ALPHA = 0.2
TICK_MINUTES = 5
DAY_MINUTES = 1440

# --------------------------------------------------------------------------
# Recommenders, welfare gate, feedback
# --------------------------------------------------------------------------
PROMINENCE_RANK = dict(prominence=0.45, relevance=0.35, proximity=0.20, personal=0.10, scale_km=5.0)
POPULARITY_RANK = dict(rating=0.25, review=0.35, popularity=0.40, personal=0.12)
PERSONAL_CAP = 0.35
# (subtype, source, position of the source in the answer)
SOURCE_ROUTES = (
    ("food_takeout", "google_maps", 0), ("food_takeout", "opentable", 1),
    ("food_dine_in", "google_maps", 0), ("food_dine_in", "opentable", 1),
    ("live_music", "spotify_ticketmaster", 0),
    ("workout_or_run", "classpass", 0),
    ("cafe_friend", "google_maps", 0),
    ("museum", "google_maps", 0),
    ("park", "google_maps", 0),
)
ORACLE_RANK = dict(speed_kmh=20.0, cost_per_km=0.15, intrinsic_default=0.25, intrinsic_weight=0.3)
ORGANIC_SCALE_KM = 3.0
GATE = dict(default_vot=15.0, speed_kmh=20.0, cost_per_km=0.15, sigma_floor=0.15, score_scale=0.70,
            pup_alpha=0.6, rm_epsilon=0.3)
DYNAMICS = dict(prior_weight=20.0, like_star=5.0, dislike_star=1.0, rating_min=1.0, rating_max=5.0,
                prior_visits=0.0)
SYNTH = dict(rating=(2.8, 4.9), reviews=(20, 5000), popularity=(1.0, 9.0), popularity_floor=10.0)
FEEDBACK = dict(activity=0.85, travel=0.25, pref=0.30, intrinsic=0.20, escape=0.10, affinity=0.15,
                outdoor_penalty=-0.25, green_park=0.10, scale=1.25, p_min=0.05, p_max=0.95, rate=0.12,
                keyword_discount=0.70, strength_floor=0.25, strength_max=2.0, strength_min=0.2,
                trust=0.16, loop=0.12, autonomy=0.10, awareness=0.08, sensitivity=0.25)
TRAVEL_COST = dict(default_vot=15.0, rate=0.15, vot_max=50.0, vot_min=5.0, up=0.05, down=0.03,
                   dislike=-0.2, like=0.3, long_min=20.0)
ETA = dict(intercept=0.52, trust=0.40, autonomy=0.40, quality=0.18, memory=0.015, memory_cap=5,
           eta_min=0.05, eta_max=0.95)
TPB = dict(attitude=1.3, norm=0.9, pbc=0.8, intercept=-1.0, leisure=0.1, pro=0.8, neutral=0.5, anti=0.2,
           own_car=0.4, carshare=0.18, transit=0.25, age75=-0.1, ada=-0.08, base=0.1)
PARTICIPATION = dict(intercept=-0.45, intention=1.05, motivation=0.70, net=0.60, boost_intrinsic=0.3,
                     boost_escape=0.2, p_max=0.95, min_net=-0.15, km=0.12, outdoor_discount=0.92,
                     outdoor_walk=30, act_intrinsic=0.35, act_escape=0.20, act_affinity=0.15,
                     act_pref=0.25, interest=0.12, noise=0.05, temperature=2.5, social=0.18, variety=0.18,
                     local=0.15, spontaneity=0.16, negative=0.12, familiarity=0.10, t_max=0.55,
                     t_spont=0.30, t_min=0.35)
TIME_WINDOW_BONUS = {
    "weekday evening": (17, 22, 0.08, -0.03),
    "weekend afternoon": (12, 18, 0.05, -0.02),
    "weekend morning": (8, 13, 0.04, -0.02),
}
INTEREST_SUBTYPES = {
    "food": ("food_takeout", "food_dine_in", "cafe_friend"),
    "nature": ("park", "workout_or_run"),
    "nightlife": ("live_music", "food_dine_in"),
    "cultural": ("museum", "cafe_friend"),
}
# (trait, weight, subtypes it applies to)
PERSONALITY = (
    ("social_orientation", 0.18, ("cafe_friend", "food_dine_in", "live_music")),
    ("variety_seeking", 0.20, ("museum", "live_music", "park")),
    ("planning_orientation", 0.12, ("museum", "food_dine_in")),
    ("spontaneity_share", 0.12, ("food_takeout", "park", "workout_or_run")),
    ("risk_aversion", -0.22, ("park", "workout_or_run")),
    ("trend_susceptibility", 0.14, ("food_dine_in", "live_music", "cafe_friend")),
)
BURDEN = dict(risk_aversion=0.35, budget_sensitivity=0.25, variety_seeking=-0.20, platform_affinity=-0.10,
              lo=0.65, hi=1.45)

# --------------------------------------------------------------------------
# personas
# --------------------------------------------------------------------------
INCOME_BANDS = {"<35k": (20000, 34000), "35-75k": (35000, 74000), "75k-125k": (75000, 124000), "125k+": (125000, 180000)}
INCOME_DEFAULT = (35000, 74000)
AGE_BANDS = {"teen": (18, 19), "young adult": (20, 34), "mid adult": (35, 54), "old adult": (55, 69), "senior": (70, 85)}
AGE_DEFAULT = (30, 55)
TRANSIT_LEVEL = {"high": 0.85, "medium": 0.55, "low": 0.25}
CAR_PENALTY = {"own car": 0.0, "carshare": 0.9}
NO_CAR_PENALTY = 2.2
MOTIVATION_SHIFT = dict(derived=0.15, intrinsic=0.18, escape=0.10, positionality=0.14)
MOTIVES = ("derived", "intrinsic", "escape", "positionality")

UNIT_TOKENS = {
    "yes": 1.0, "no": 0.0, "true": 1.0, "false": 0.0, "high": 0.8, "medium": 0.5, "med": 0.5, "low": 0.2,
    "option a": 1.0, "a": 1.0, "option b": 0.0, "b": 0.0, "it depends": 0.5, "depends": 0.5,
}

# canonical trait -> column aliases, first non-blank wins
BIG_FIVE_ALIASES = {
    "openness": ("openness", "bigfive_openness", "bfi_openness", "lv_openness", "Openness"),
    "conscientiousness": ("conscientiousness", "bigfive_conscientiousness", "bfi_conscientiousness",
                          "lv_conscientiousness", "Conscientiousness"),
    "extraversion": ("extraversion", "bigfive_extraversion", "bfi_extraversion", "lv_extraversion", "Extraversion"),
    "agreeableness": ("agreeableness", "bigfive_agreeableness", "bfi_agreeableness", "agreeable_composite",
                      "Agreeableness"),
    "neuroticism": ("neuroticism", "bigfive_neuroticism", "bfi_neuroticism", "neurotic_composite", "Neuroticism"),
}
LATENT_ALIASES = {
    "maximization": ("maximization", "lv_maximization", "Maximization"),
    "trust_platforms": ("trust_platforms", "lv_trust_platforms", "platform_trust"),
    "autonomy_preference": ("autonomy_preference", "lv_autonomy", "autonomy_control"),
    "algorithmic_awareness": ("algorithmic_awareness", "lv_algorithmic_awareness", "algorithm_awareness"),
}
ITEM_ALIASES = {
    "local_leisure_frequency": ("q12_leisure_freq", "local_leisure_frequency"),
    "overnight_trip_frequency": ("q13_overnight_freq", "overnight_trip_frequency"),
    "spontaneity_share": ("q14_spontaneity", "spontaneity_share"),
    "follow_through_friend": ("q17_follow_friend", "follow_through_friend"),
    "follow_through_platform": ("q18_follow_platform", "follow_through_platform"),
    "follow_through_ai": ("q19_follow_ai", "follow_through_ai"),
    "incentive_coupon": ("q2_5a_coupon", "incentive_coupon"),
    "incentive_sponsored": ("q2_5b_sponsored", "incentive_sponsored"),
    "incentive_loyalty": ("q2_5c_loyalty", "incentive_loyalty"),
    "cross_platform_search": ("search_depth", "cross_platform_search"),
    "price_filter_tendency": ("price_filter_tendency", "price_filter_use"),
    "group_coordination_preference": ("group_coordination_preference",),
    "popularity_herding": ("q2_4i_trending", "popularity_herding"),
    "unexpected_discovery": ("q2_4e_serendipity", "unexpected_discovery"),
    "negative_recommendation_experience": ("q2_4k_negative_platform", "q6_1f_disappointing_recommendation",
                                           "negative_recommendation_experience"),
    "review_posting": ("q6_4a_review", "review_posting"),
    "social_posting": ("q6_4b_social_post", "social_posting"),
    "switch_when_dissatisfied": ("q6_4c_switch_platform", "switch_when_dissatisfied"),
    "multi_platform_parallel": ("q6_4d_multi_platform", "multi_platform_parallel"),
    "advice_goal_directed": ("q22_advice_preference", "advice_goal_directed"),
    "objective_algorithmic_literacy": ("q21_algorithmic_literacy", "objective_algorithmic_literacy"),
    "city_familiarity": ("q11_city_familiarity", "city_familiarity"),
    "budget_tightness": ("budget_tightness",),
    "ai_itinerary_comfort": ("q6_1e_ai_itinerary", "ai_itinerary_comfort"),
    "explanation_needed": ("q6_1c_explanation_trust", "explanation_needed"),
}
# item families whose scale is not 1..7
ITEM_SCALES = {
    "incentive_coupon": (1.0, 5.0), "incentive_sponsored": (1.0, 5.0), "incentive_loyalty": (1.0, 5.0),
    "spontaneity_share": (0.0, 100.0), "local_leisure_frequency": (0.0, 7.0),
    "overnight_trip_frequency": (0.0, 12.0), "budget_tightness": (0.0, 1.0),
    "advice_goal_directed": (0.0, 1.0), "objective_algorithmic_literacy": (0.0, 1.0),
}
TRAITS = tuple(BIG_FIVE_ALIASES) + tuple(LATENT_ALIASES) + tuple(ITEM_ALIASES)

# coefficient -> {trait: weight}; a leading "~" stands for one minus the trait
COEFFICIENTS = {
    "platform_affinity": {"trust_platforms": 0.30, "algorithmic_awareness": 0.25,
                          "follow_through_platform": 0.25, "follow_through_ai": 0.20},
    "autonomy_guard": {"autonomy_preference": 0.70, "algorithmic_awareness": 0.30},
    "planning_orientation": {"conscientiousness": 0.45, "maximization": 0.35, "~spontaneity_share": 0.20},
    "social_orientation": {"extraversion": 0.55, "group_coordination_preference": 0.30, "social_posting": 0.15},
    "variety_seeking": {"openness": 0.55, "unexpected_discovery": 0.25, "advice_goal_directed": 0.20},
    "risk_aversion": {"neuroticism": 0.65, "autonomy_preference": 0.15, "algorithmic_awareness": 0.10,
                      "negative_recommendation_experience": 0.10},
    "budget_sensitivity": {"budget_tightness": 0.60, "@incentives": 0.40},
    "trend_susceptibility": {"popularity_herding": 0.55, "agreeableness": 0.25, "follow_through_platform": 0.20},
    "ai_affinity": {"follow_through_ai": 0.30, "ai_itinerary_comfort": 0.25, "trust_platforms": 0.20,
                    "~autonomy_preference": 0.25},
    "feedback_loop_strength": {"review_posting": 0.25, "switch_when_dissatisfied": 0.45,
                               "multi_platform_parallel": 0.30},
}
# overlay target -> ((driver, weight), ...), lower clamp, upper clamp
OVERLAY = {
    "pref_time": ((("planning_orientation", 0.25), ("maximization", 0.15)), 0.45, 1.80),
    "pref_cost": ((("budget_sensitivity", 0.35), ("price_filter_tendency", 0.20)), 0.45, 1.80),
    "pref_comfort": ((("risk_aversion", 0.28),), 0.0, 1.5),
    "pref_green": ((("openness", 0.20),), 0.0, 1.2),
    "travel_affinity": ((("variety_seeking", 0.25), ("local_leisure_frequency", 0.20)), 0.0, 1.0),
    "status_seeking": ((("trend_susceptibility", 0.28),), 0.0, 1.0),
    "practice_conformity": ((("social_orientation", 0.20), ("trend_susceptibility", 0.20)), 0.0, 1.0),
    "feedback_sensitivity": ((("feedback_loop_strength", 0.35), ("risk_aversion", 0.20)), 0.5, 1.8),
    "loss_aversion": ((("risk_aversion", 0.95),), 1.05, 4.0),
    "satisficing_threshold": ((("budget_sensitivity", 2.0), ("maximization", -1.3)), 1.0, None),
}
MOTIVE_OVERLAY = {
    "derived": ("planning_orientation", 0.20),
    "intrinsic": ("variety_seeking", 0.30),
    "escape": ("spontaneity_share", 0.18),
    "positionality": ("trend_susceptibility", 0.25),
}
PARADIGMS = ("utility", "regret", "prospect", "satisficing", "habit")
PARADIGM_WEIGHTS = {
    "utility": {"variety_seeking": 0.45},
    "regret": {"maximization": 0.85},
    "prospect": {"risk_aversion": 0.90},
    "satisficing": {"budget_sensitivity": 0.80, "planning_orientation": 0.35},
    "habit": {"autonomy_guard": 0.75, "~variety_seeking": 0.45},
}
MODE_BIAS = {
    "walk": {"variety_seeking": 0.16, "budget_sensitivity": 0.12, "risk_aversion": -0.14},
    "bike": {"variety_seeking": 0.18, "pref_green": 0.14, "risk_aversion": -0.20},
    "transit": {"budget_sensitivity": 0.18, "platform_affinity": 0.08},
    "car": {"autonomy_guard": 0.18, "risk_aversion": 0.12, "pref_green": -0.22},
}

# --------------------------------------------------------------------------
# studies
# --------------------------------------------------------------------------
# (name, gate mode, probability threshold, regret ceiling)
TREATMENTS = (
    ("no_rs", "no_rs", 0.6, 0.3),
    ("standard", "standard", 0.6, 0.3),
    ("pup_03", "pup", 0.3, 0.3),
    ("pup_07", "pup", 0.7, 0.3),
    ("rm", "rm", 0.6, 0.2721),
    ("oracle", "oracle", 0.6, 0.3),
)
# Seed counts outside 1 to this are reported, not cut.
MAX_SEEDS = 12
ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
PERCENTILES = (50, 60, 65, 70, 75, 80, 90)
NEUTRAL = 1e-9
# Points of a compact record where a caller asks for the short form.
MAX_PATH_POINTS = 12
