"""Fixed values that decide results: class names, term lists, weights, cut points and default texts."""

# Text classes, in canonical order.
TEXT_CLASSES = [
    "genuine_positive",
    "genuine_negative",
    "spam",
    "advertisement",
    "irrelevant",
    "fake_rant",
    "inappropriate",
]
GENUINE_CLASSES = TEXT_CLASSES[:2]
BAD_CLASSES = TEXT_CLASSES[2:]

# Term lists of the rule scorer.
SPAM_TERMS = [
    "buy now", "click here", "limited time", "free offer", "visit our website", "www.", "http",
    "discount", "sale",
]
AD_TERMS = [
    "best deal", "lowest price", "guaranteed", "special offer", "call now", "order today",
    "promocode", "promo",
]
EXTREME_TERMS = [
    "worst", "terrible", "horrible", "awful", "never again", "disaster", "nightmare", "disgusting",
]
INAPPROPRIATE_TERMS = ["inappropriate", "offensive", "vulgar"]
POSITIVE_TERMS = ["great", "good", "excellent", "amazing", "wonderful", "love"]
NEGATIVE_TERMS = ["bad", "poor", "disappointing", "not good"]

# Confidence of each rule; 0.1 is the base mass of every class before normalising.
RULE_CONFIDENCE = {
    "spam": 0.8,
    "advertisement": 0.75,
    "fake_rant": 0.7,
    "irrelevant": 0.65,
    "inappropriate": 0.7,
    "genuine": 0.6,
}
RULE_BASE_MASS = 0.1

# Zero-shot category names and the class each one stands for.
ZERO_SHOT_CATEGORIES = {
    "genuine positive review": "genuine_positive",
    "genuine negative review": "genuine_negative",
    "spam": "spam",
    "advertisement": "advertisement",
    "irrelevant content": "irrelevant",
    "fake rant": "fake_rant",
    "inappropriate content": "inappropriate",
}

# Class weights of the weighted text score, in canonical class order.
TEXT_CLASS_WEIGHTS = [1.0, 1.0, -2.0, -1.5, -1.0, -2.0, -2.0]

# Decisions, codes and routes.
DECISIONS = ["genuine", "suspicious", "low-quality", "high-confidence-spam"]
ROUTES = {
    "genuine": "automatic-approval",
    "suspicious": "requires-manual-verification",
    "low-quality": "requires-manual-verification",
    "high-confidence-spam": "automatic-rejection",
}
ROUTE_DESCRIPTIONS = {
    "automatic-approval": "This review can be automatically approved for publication.",
    "requires-manual-verification": "This review requires human verification before publication.",
    "automatic-rejection": "This review should be automatically rejected.",
}
UNKNOWN_ROUTE = "Unknown routing decision"

# Serving map and evaluation map from text class to decision; they differ on purpose.
SERVING_DECISION = {
    "genuine_positive": "genuine",
    "genuine_negative": "genuine",
    "spam": "high-confidence-spam",
    "advertisement": "suspicious",
    "irrelevant": "low-quality",
    "fake_rant": "suspicious",
    "inappropriate": "high-confidence-spam",
}
TRUTH_DECISION = {
    "genuine_positive": "genuine",
    "genuine_negative": "genuine",
    "spam": "high-confidence-spam",
    "advertisement": "high-confidence-spam",
    "irrelevant": "low-quality",
    "fake_rant": "suspicious",
    "inappropriate": "high-confidence-spam",
}

# Risk tiers.
TIERS = ["genuine", "low_risk", "medium_risk", "high_risk"]
TIER_CUTS = (0.35, 0.55, 0.8)
TIER_PRESETS = {
    "conservative": (0.25, 0.45, 0.7),
    "balanced": (0.35, 0.55, 0.8),
    "aggressive": (0.45, 0.65, 0.85),
}
# Decision thresholds: spam, genuine, low quality.
DECISION_THRESHOLDS = {
    "default": (0.35, 0.25, 0.15),
    "recommended": (0.30, 0.20, 0.18),
    "maximum_automation": (0.25, 0.15, 0.20),
}
# Target shares of the decisions, lower and upper bound in percent.
TARGET_SHARES = {
    "genuine": (40.0, 50.0),
    "suspicious": (20.0, 25.0),
    "low-quality": (10.0, 15.0),
    "high-confidence-spam": (20.0, 25.0),
}
DECISION_CLASS_WEIGHTS = {
    "genuine": 1.2,
    "suspicious": 0.8,
    "low-quality": 1.1,
    "high-confidence-spam": 1.2,
}

# Feature groups of the anomaly stage.
TEMPORAL_FEATURES = [
    "review_day_of_week", "review_hour_of_day", "is_weekend", "days_since_last_review",
    "rolling_7d_stars_mean", "rolling_7d_stars_count", "rolling_30d_stars_mean",
    "rolling_30d_stars_count",
]
USER_FEATURES = [
    "user_review_count", "user_avg_rating", "user_rating_std", "user_min_rating", "user_max_rating",
    "user_unique_text_ratio", "user_rating_deviation",
]
CONTENT_FEATURES = ["has_image", "image_count", "text_length", "language_match"]
BUSINESS_FEATURES = [
    "business_avg_rating", "business_rating_std", "business_review_count",
    "business_rating_deviation",
]
USER_RISK_FEATURES = ["user_avg_quality_risk", "user_max_quality_risk", "user_avg_spam_prob"]
CONTENT_RISK_FEATURES = [
    "text_quality_risk", "text_spam_prob", "text_ad_prob", "content_quality_score",
    "simplicity_confidence_ratio", "spam_length_ratio",
]
BUSINESS_RISK_FEATURES = ["business_avg_quality_risk", "business_quality_risk_deviation"]
TEXT_FEATURES = [
    "text_confidence", "text_quality_risk", "text_high_quality_score", "text_weighted_quality",
    "text_weighted_risk",
]
CATEGORY_THRESHOLD = 0.6
WINDOW_DAYS = {"short": 7, "medium": 30, "long": 90}

# Names of the 20 fusion features, in order.
FUSION_FEATURES = [
    "p_bad", "enhanced_prob", "relevancy", "is_relevant", "confidence", "ensemble_prob", "p_spam",
    "p_advertisement", "p_irrelevant", "p_fake_rant", "p_inappropriate", "p_bad_sq",
    "enhanced_prob_sq", "relevancy_sq", "p_bad_x_enhanced", "p_bad_x_relevancy",
    "enhanced_x_relevancy", "p_bad_x_confidence", "enhanced_x_confidence", "irrelevance_penalty",
]

# Defaults of the metadata fill.
UNKNOWN_BUSINESS = "unknown_business"
DEFAULT_PUBLISHED = "2024-01-01"
DEFAULT_REVIEW_COUNT = 10

# Column aliases, first present wins.
COLUMN_ALIASES = {
    "stars": ["rating", "score", "stars", "star_rating"],
    "published_at": ["date", "timestamp", "created_at", "review_date"],
    "helpful_votes": ["helpful", "helpful_count", "thumbs_up", "likes"],
    "text_length": ["length", "text_length", "character_count"],
}

# Labelling texts.
LABEL_BATCH = 8
PROMPT_REVIEW_CHARS = 1000
PROMPT_HEAD = """Sort each customer review below into one class:
genuine_positive (a real visit, praised), genuine_negative (a real visit, criticised with reasons), spam (made up or generic filler),
advertisement (promotes something), irrelevant (about something else), fake_rant (rage without substance),
inappropriate (insults or harm).
Prefer concrete detail as a sign of a real visit. State how sure you are and say why in a few words.

Reviews:
"""
PROMPT_TAIL = """
Answer with one JSON array, one object per review in order, with the keys "classification", "confidence" (0 to 1) and "reasoning".
"""
FIELD_DEFAULT_REASON = "Automatic classification"
PARSE_DEFAULT_REASON = "Parse error - default classification"
PROVIDER_DEFAULT_REASON = "All providers failed"

# Report texts.
RECOMMEND_HIGH_RISK = "⚠️  High proportion of risky reviews detected - manual review recommended"
RECOMMEND_MEAN_RISK = "🔍 Overall high risk score - consider additional validation"
RECOMMEND_LOW_RISK = "✅ Mostly genuine reviews - system performance looks good"
VIOLATION_NAMES = {
    "advertisement": "Advertisement",
    "spam": "Spam Content",
    "irrelevant": "Irrelevant",
    "inappropriate": "Inappropriate",
}
HIGH_RISK_VIOLATION = "High Risk Score"
COMPLEMENT_REPORT = [
    ("Stage 1 Coverage", "stage1_coverage", "Fraction of problematic samples caught by Stage 1"),
    ("Stage 2 Coverage", "stage2_coverage", "Fraction of problematic samples caught by Stage 2"),
    ("Combined OR Coverage", "combined_or_coverage", "Fraction caught by either stage (union)"),
    ("Stage 2 Recovery Rate", "stage2_recovery_rate", "Fraction of Stage 1 misses that Stage 2 recovers"),
    ("Stage 2 Unique Catches", "stage2_unique_catches", "Number of problematic samples only Stage 2 caught"),
    ("Stage 2 Unique Precision", "stage2_unique_precision", "Precision when Stage 2 flags but Stage 1 does not"),
    ("False Negative Reduction", "false_negative_reduction", "Reduction in missed problematic samples"),
    ("False Positive Increase", "false_positive_increase", "Increase in false alarms (per sample)"),
    ("Agreement Rate", "overall_agreement", "Overall agreement between stages"),
]

# Category vocabularies of the relevancy score.
CATEGORY_TERMS = {
    "Restaurant": ["food", "service", "atmosphere", "dining"],
    "Hotel": ["accommodation", "amenities", "location", "service"],
    "Cafe": ["coffee", "ambiance", "study", "beverages"],
    "Shopping Mall": ["stores", "variety", "parking", "facilities"],
}
OFF_TOPIC_TERMS = ["buy now", "click here", "http", "promo", "visit our website"]
PRAISE_PHRASES = ["best place ever", "highly recommend", "go now", "amazing", "great love"]
