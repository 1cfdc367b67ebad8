"""Default parameter values. Every operator takes its lists as arguments."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Values that results depend on, stated as they are.

SHEETS_TO_EXCLUDE = (
    "large company list (accumulated", "keywords", "ideal tableau format",
)

PROVENANCE_HEADERS = ("sheet name", "sheetname", "sheet_name")

NON_TEXT_COLUMNS = ("survey_id", "question_id", "response_id", "timestamp", "sheet_name")

GENERIC_WORDS = (
    "yes", "no", "maybe", "perhaps", "sure", "okay", "ok", "alright", "fine", "good",
    "bad", "great", "excellent", "poor", "terrible", "awesome", "amazing", "horrible",
    "wonderful", "nice", "well", "very", "really", "so", "too", "quite", "pretty",
    "kind", "sort", "bit", "lot", "lots", "much", "many", "some", "any", "all",
    "none", "every", "each", "both", "either", "neither", "one", "two", "three",
    "four", "five", "first", "second", "third", "last", "next", "new", "old",
    "big", "small", "large", "little", "long", "short", "high", "low", "right",
    "wrong", "true", "false", "able", "unable", "possible", "impossible",
)

POSITIVE_WORDS = (
    "good", "great", "excellent", "positive", "love", "best",
    "happy", "thank", "amazing", "wonderful", "helpful", "useful",
)

NEGATIVE_WORDS = (
    "bad", "terrible", "poor", "negative", "hate", "worst",
    "sad", "problem", "difficult", "hard", "confusing", "frustrating",
)

# Cell texts that mean "no value" in a CSV (the pandas defaults).
NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

SIMILARITY_THRESHOLD = 0.35
SENTIMENT_CUTOFF = 0.05

# Degree adverbs and negations of the rule-based compound score
# (Hutto and Gilbert, ICWSM 2014), with its published scalars.
BOOST = 0.293
DAMPEN = -0.293
CAPS_BOOST = 0.733
NEGATION_SCALE = -0.74
NORMALISER = 15.0

BOOSTERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly",
    "deeply", "effing", "enormously", "entirely", "especially", "exceptionally",
    "extremely", "fabulously", "flipping", "fricking", "frigging", "fully", "greatly",
    "hella", "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
    "thoroughly", "totally", "tremendously", "uber", "unbelievably", "unusually",
    "utterly", "very",
)

DAMPENERS = (
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of",
    "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly",
    "somewhat", "sort of", "sorta", "sortof", "sort-of",
)

NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't",
    "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "don't", "hadn't",
    "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't", "never",
    "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt",
    "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't",
    "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom",
    "despite",
)

IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0,
    "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1,
    "broken heart": -2.9,
}

# Spark's English stop words (StopWordsRemover), in its order.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've",
    "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's",
    "when's", "where's", "who's", "why's", "would",
)
