"""Spellings, thresholds, labels and word lists used by the expressions."""

# Spellings that mean "missing" (compared after trimming).
MISSING_TOKENS = [
    "NEW", "-", "NULL", "N/A", "NA", "nan", "NaN",
    "none", "None", "NONE", "n/a", "null", "#N/A",
    "",
]

# Spellings that mean "yes" (compared lower-case, trimmed).
YES_TOKENS = ["yes", "1", "true"]

# Rating words; a rating below the edge gets the label, the last label is open-ended.
RATING_WORDS = ([3.0, 4.0], ["Bad", "Good", "Excellent"])
RATING_TIERS = ([3.0, 4.0], ["Low", "Average", "High"])
RATING_CLASSES = [1, 2, 3, 4, 5]

# Average sentiment at or above the edge gets the label, in descending order.
SENTIMENT_TIERS = [
    (0.5, "Highly Positive"),
    (0.2, "Positive"),
    (-0.05, "Mixed"),
    (-0.2, "Negative"),
]
SENTIMENT_LOWEST_TIER = "Highly Negative"

# Review labels, thresholds and budgets.
SENTIMENT_CUT = 0.05
LOW_REVIEW_COUNT = 3
REVIEW_WORD_BUDGET = 350
HIGH_RATING = 3.8

# Keyword extraction.
MAX_TERMS = 8000
MAX_DF = 0.85
REVIEW_KEYWORDS = 7
DISH_KEYWORDS = 5

# Corpus and search.
CHUNK_SIZE = 600
CHUNK_OVERLAP = 60
VECTOR_DIMS = 384
TOP_K = 8

# Frequently asked questions that join the corpus.
FAQS = [
    (
        "How do I cancel my order?",
        "Go to Orders, select the active order, and tap Cancel. Refunds are processed within 5-7 business days.",
    ),
    (
        "How does table booking work?",
        "Search a restaurant, check slot availability, and confirm. Some restaurants require a refundable deposit.",
    ),
]

# The venue description over its columns, what stands for a missing value, and the sentences that some
# columns make (none where the column is empty).
NARRATIVE = (
    "{name} is a {rest_type} located in {location}, offering {cuisines}. "
    "Popular or frequently ordered dishes include: {dish_liked}. "
    "The approximate cost for two people is ₹{cost_for_two}. The overall user rating stands at {rate}. "
    "{dominant_sentiment} {keywords} {menu_item} Detailed customer review text: {clean_review}"
)
NARRATIVE_MISSING = {
    "name": "", "rest_type": "restaurant", "location": "an unspecified location", "cuisines": "a variety of cuisines",
    "dish_liked": "unspecified dishes", "cost_for_two": "N/A", "rate": "N/A", "clean_review": "No direct review text available.",
}
NARRATIVE_SENTENCES = {
    "dominant_sentiment": "Overall customer feedback is predominantly {}.",
    "keywords": "Common topics and key phrases in customer feedback include: {}.",
    "menu_item": "Notable menu highlights include {}.",
}

# Typed metadata of a document.
META_FIELDS = {
    "doc_type": "string", "name": "string", "location": "string", "cuisines": "string", "rest_type": "string",
    "cost_for_two": "double", "rating": "double", "rating_is_imputed": "boolean", "online_order": "string",
    "book_table": "string", "menu_available": "boolean", "sentiment_score": "double", "sentiment_label": "string",
    "positive_ratio": "double", "keywords": "string", "dish_keywords": "string", "review_quality": "string",
    "nlp_source": "string", "question": "string",
}

# English stop words that can survive the letters-only cleaning.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain
aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# Valences of common words on the scale -4..4, from the published lexicon of Hutto & Gilbert (2014); callers
# may bring the whole table.
VALENCE = {
    "amazing": 2.8, "awesome": 3.1, "awful": -2.0, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "better": 1.9,
    "bitter": -1.8, "bland": -1.4, "boring": -1.3, "brilliant": 2.8, "burnt": -1.4, "charming": 2.8,
    "clean": 1.7, "cold": -0.9, "comfortable": 2.3, "delicious": 2.7, "delightful": 2.8, "dirty": -1.9,
    "disappointed": -2.1, "disappointing": -2.2, "disgusting": -2.4, "dull": -1.7, "enjoy": 2.2,
    "enjoyed": 2.3, "excellent": 2.7, "fantastic": 2.6, "favorite": 2.0, "fine": 0.8, "fresh": 1.3,
    "friendly": 2.2, "fun": 2.3, "good": 1.9, "great": 3.1, "happy": 2.7, "hate": -2.7, "horrible": -2.5,
    "hot": 0.5, "incredible": 2.4, "love": 3.2, "loved": 2.9, "lovely": 2.8, "nice": 1.8, "okay": 0.9,
    "overpriced": -1.6, "perfect": 2.7, "pleasant": 2.3, "poor": -2.1, "recommend": 1.5, "rude": -2.0,
    "sad": -2.1, "slow": -0.7, "spoiled": -1.8, "stale": -1.6, "super": 2.9, "superb": 3.1, "tasty": 2.0,
    "terrible": -2.1, "unhappy": -1.8, "warm": 0.9, "waste": -1.8, "wonderful": 2.7, "worst": -3.1,
    "wow": 2.8, "wrong": -2.1, "yummy": 2.4,
}

# Negations flip, boosters strengthen or weaken a valence up to three words later.
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent",
    "isnt", "neither", "never", "no", "none", "nope", "nor", "not", "nothing", "nowhere", "rarely",
    "seldom", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt",
]
BOOSTERS_UP = [
    "absolutely", "amazingly", "completely", "considerably", "deeply", "especially", "exceptionally",
    "extremely", "highly", "hugely", "incredibly", "really", "remarkably", "so", "thoroughly", "totally",
    "truly", "utterly", "very",
]
BOOSTERS_DOWN = ["almost", "barely", "hardly", "kinda", "marginally", "partly", "scarcely", "slightly", "somewhat"]
NEGATION_FACTOR = -0.74
BOOST_STEP = 0.293
BOOST_DAMPING = [1.0, 0.95, 0.9]
# Fixed values of the same paper: idioms count as a whole; words before a contrast count less, those after it more;
# capitals stress a word where others are in small letters; repeated question marks strengthen.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0,
    "beating heart": 3.1, "broken heart": -2.9,
}
CONTRAST, CONTRAST_BEFORE, CONTRAST_AFTER = "but", 0.5, 1.5
CAPITALS_STEP = 0.733
QUESTION_STEP, QUESTIONS_MANY = 0.18, 0.96
EXCLAMATION_STEP = 0.292
MAX_EXCLAMATIONS = 4
NORMALIZER = 15.0

# Irregular nouns and what the ending rules would spoil; other plurals follow the rules.
LEMMA_EXCEPTIONS = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose",
    "oxen": "ox", "knives": "knife", "lives": "life", "wives": "wife", "leaves": "leaf", "loaves": "loaf", "halves": "half",
    "shelves": "shelf", "calves": "calf", "wolves": "wolf", "thieves": "thief", "selves": "self", "potatoes": "potato",
    "tomatoes": "tomato", "mangoes": "mango", "mosquitoes": "mosquito", "heroes": "hero", "echoes": "echo", "pies": "pie",
    "ties": "tie", "movies": "movie", "cookies": "cookie", "smoothies": "smoothie", "veggies": "veggie", "brownies": "brownie",
    "species": "species", "series": "series", "news": "news", "asparagus": "asparagus", "molasses": "molasses",
    "analyses": "analysis", "crises": "crisis", "bases": "basis", "criteria": "criterion", "phenomena": "phenomenon",
    "gas": "gas", "lens": "lens", "always": "always", "perhaps": "perhaps", "previous": "previous",
}
