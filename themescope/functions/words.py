"""Word lists used by sentiment and keyword extraction.

Fixed values: results depend on these exact entries.
"""

NEGATIVE = [
    "bad", "poor", "terrible", "awful", "horrible", "worst", "not satisfied",
    "not professional", "complaint", "complain", "useless", "rubbish",
    "unfriendly", "rude", "disappointed", "frustrated", "angry", "annoying",
    "absurd", "ridiculous", "loop", "waste", "garbage", "crap", "no help at all",
    "waste my time", "stupid", "not good", "not friendly", "not helpful",
]

POSITIVE = [
    "great", "excellent", "amazing", "satisfied", "helpful", "friendly",
    "fast", "quick", "easy", "appreciate", "perfect", "wonderful", "awesome",
    "nice", "pleased", "best", "fantastic", "superb", "outstanding", "brilliant",
    "terrific", "exceptional", "recommend", "recommended", "professional",
    "fully resolved", "very helpful", "nice experience", "all good", "very good",
]

STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "from", "is", "are", "was", "were", "be", "been", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "can", "i", "you", "he", "she", "it", "we", "they", "my",
    "your", "his", "her", "its", "our", "their", "this", "that", "these",
    "those", "what", "which", "who", "when", "where", "why", "how", "hi",
    "hello", "hey", "please", "thank", "thanks", "yes", "no", "ok", "okay",
    "need", "want", "get", "got", "go", "went", "come", "came",
]

# Used when a lexicon file is missing or broken. Fixed values.
FALLBACK_NEGATIVE = ["bad"]
FALLBACK_POSITIVE = ["good"]
