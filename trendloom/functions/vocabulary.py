"""Word lists that labels, keywords and replies are judged by."""

# Fixed values.
GENERIC_LABEL_WORDS = [
    "analysis", "approach", "based", "model", "models", "method", "methods", "methodology",
    "system", "systems", "framework", "architecture", "architectures", "design",
    "application", "applications", "implementation", "performance", "evaluation", "results",
    "optimization", "control", "management", "detection", "classification", "prediction",
    "algorithm", "algorithms", "data", "learning", "network", "networks", "study", "research",
]
GENERIC_KEYWORDS = GENERIC_LABEL_WORDS + [
    "paper", "thesis", "dissertation", "propose", "proposes", "proposed", "present", "presents", "presented",
    "using", "use", "used", "novel", "new", "existing", "problem", "problems", "challenge", "challenges",
]
WEAK_LABELS = ["misc", "other", "others", "unknown", "general", "topic"]
GENERIC_CONCEPTS = [
    "computer science", "computer sciences", "computer system", "computer systems",
    "software", "software engineering", "information system", "information systems",
    "engineering", "data", "dataset", "datasets", "algorithm", "algorithms",
    "machine learning", "artificial intelligence",
]
ABSTENTIONS = ["outlier", "no match", "unknown", "n/a", "uncertain", "none"]
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"
DASHES = "‐‑‒–—−"
KEYWORD_COLUMNS = ["keywords_core", "keywords", "keywords_display", "representation", "topic_label", "label", "name", "Name"]
# English words too frequent to be keywords.
STOP_WORDS = [
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by",
    "can", "could", "do", "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "may", "more", "most", "no", "not", "of", "on", "one", "or", "other", "our",
    "out", "over", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there",
    "these", "they", "this", "those", "through", "to", "under", "up", "was", "we", "were", "what", "when",
    "which", "who", "will", "with", "would", "you", "your",
]
