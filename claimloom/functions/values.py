"""Fixed tables: source credibility, half-lives, cue words, label names."""

# Fixed values, in order: the first entry contained in a source or URL decides.
CREDIBILITY = [
    ("gov", 1.0), ("edu", 0.95), ("int", 0.9), ("india.gov.in", 1.0), ("pib.gov.in", 0.98), ("parliament.uk", 0.98), ("whitehouse.gov", 0.98), ("europa.eu", 0.98),
    ("indiacode.nic.in", 1.0), ("sci.gov.in", 0.98), ("ecourts.gov.in", 0.98), ("justice.gov", 0.96), ("archives.gov", 0.96), ("nationalarchives.gov.uk", 0.96),
    ("loc.gov", 0.95), ("rbi.org.in", 0.96), ("federalreserve.gov", 0.96), ("census.gov", 0.95), ("mospi.gov.in", 0.95), ("isro.gov.in", 0.98), ("nasa.gov", 0.98),
    ("jpl.nasa.gov", 0.98), ("esa.int", 0.96), ("who.int", 0.98), ("cdc.gov", 0.98), ("nih.gov", 0.98), ("ncbi.nlm.nih.gov", 0.98), ("ipcc.ch", 0.98), ("unep.org", 0.95),
    ("epa.gov", 0.96), ("noaa.gov", 0.96), ("usgs.gov", 0.96), ("unesco.org", 0.95), ("unicef.org", 0.95), ("un.org", 0.95),
    ("reuters", 0.9), ("ap", 0.9), ("bbc", 0.85), ("nytimes", 0.85), ("apnews.com", 0.9), ("reuters.com", 0.9), ("ft.com", 0.88), ("wsj.com", 0.88), ("economist.com", 0.86),
    ("wikipedia", 0.75), ("wikidata.org", 0.8), ("britannica.com", 0.9), ("nature.com", 0.92), ("science.org", 0.92), ("sciencedirect.com", 0.88), ("springer.com", 0.87),
    ("arxiv.org", 0.86), ("ieee.org", 0.9), ("nist.gov", 0.95), ("cisa.gov", 0.95), ("owasp.org", 0.86), ("developer.mozilla.org", 0.85), ("history.com", 0.78),
    ("worldbank.org", 0.95), ("imf.org", 0.95), ("oecd.org", 0.93), ("wto.org", 0.93), ("iucn.org", 0.9), ("pewresearch.org", 0.9), ("law.cornell.edu", 0.9),
    ("olympics.com", 0.9), ("fifa.com", 0.86), ("icc-cricket.com", 0.86), ("worldathletics.org", 0.86), ("imdb.com", 0.82), ("rottentomatoes.com", 0.8),
    ("metacritic.com", 0.78), ("boxofficemojo.com", 0.8), ("bfi.org.uk", 0.82), ("geonames.org", 0.88), ("mayoclinic.org", 0.9), ("medium", 0.6), ("blog", 0.5),
    ("twitter", 0.25), ("facebook", 0.25), ("reddit", 0.35), ("youtube", 0.4),
]

HALF_LIFE = {
    "HEALTH": 12, "TECHNOLOGY": 18, "POLITICS_GOVERNMENT": 48, "ECONOMICS_BUSINESS": 24, "SCIENCE": 36, "HISTORY": 999, "GEOGRAPHY": 999, "SPACE_ASTRONOMY": 60,
    "ENVIRONMENT_CLIMATE": 36, "SOCIETY_CULTURE": 60, "LAW_CRIME": 60, "SPORTS": 12, "ENTERTAINMENT": 24, "GENERAL_FACTUAL": 999,
}

HIGH_TRUST = ["gov.in", "gov", "edu", "who.int", "cdc.gov", "nih.gov", "nasa.gov", "isro.gov.in", "reuters.com", "apnews.com", "bbc.com", "ft.com", "wsj.com", "economist.com", "nature.com", "science.org", "worldbank.org", "imf.org"]
LOW_TRUST = ["blogspot", "wordpress", "substack", "reddit", "quora", "facebook", "instagram", "twitter", "x.com", "youtube", "dailymotion", "pinterest", "tiktok", "rumor", "gossip", "forums", "forum", "thread"]
DISCUSSION = r"/questions?/|/qna/|/forum/|/community/|/comments?/|/threads?/"

SUPPORT_CUES = ["confirmed", "verified", "true", "correct", "accurate", "supports", "agrees", "consistent", "validates", "proves", "evidence shows"]
REFUTE_CUES = ["false", "incorrect", "debunked", "misleading", "wrong", "disproves", "contradicts", "refutes", "denies", "not true", "hoax", "fake"]
NEUTRAL_CUES = ["unclear", "uncertain", "mixed", "partial", "some evidence", "conflicting", "inconclusive", "needs more"]
POLARITY_SUPPORT = ["confirmed", "confirms", "true", "accurate", "official", "announced", "stated", "says", "reported", "verified", "indeed"]
POLARITY_REFUTE = ["false", "fake", "hoax", "misleading", "denied", "denies", "not true", "did not", "no evidence", "incorrect", "refuted", "contradicts"]
OPINION = ["i think", "i believe", "in my opinion", "i feel", "should", "ought to", "favorite"]
LABELS = {
    "support": "support", "supports": "support", "supported": "support", "true": "support", "entailment": "support", "1": "support",
    "refute": "refute", "refutes": "refute", "refuted": "refute", "false": "refute", "contradiction": "refute", "2": "refute",
    "neutral": "neutral", "not enough info": "neutral", "nei": "neutral", "unknown": "neutral", "0": "neutral",
}
