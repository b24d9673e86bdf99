"""Fixed word lists. Results depend on these exact values."""

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Words that say nothing about why a review is negative.
DOMAIN_STOP_WORDS = ["product", "item", "food", "amazon", "buy", "purchased", "purchase", "review"]

# Words of a marketing tone.
MARKETING_WORDS = [
    "best", "amazing", "perfect", "ultimate", "limited", "exclusive", "must-have", "super", "top",
    "incredible", "love", "enjoy", "happy",
]

# Category of a negative keyword. A term listed twice belongs to the later category.
REASON_CATEGORIES = {
    "taste": ["taste", "flavor", "flavour", "bitter", "sweet", "sour", "salty", "bland"],
    "quality": ["quality", "bad", "poor", "low", "cheap", "awful", "terrible"],
    "expired": ["expired", "expiry", "date", "stale", "rotten", "spoiled", "moldy"],
    "packaging": ["package", "packaging", "box", "broken", "damaged", "seal", "leak", "crushed"],
    "price": ["price", "expensive", "overpriced", "cost", "worthless"],
    "delivery": ["late", "delivery", "ship", "arrive", "slow"],
    "quantity": ["small", "large", "size", "quantity", "amount", "little", "lot"],
    "smell": ["smell", "odor", "stink", "foul", "sour"],
}

# The words a word tokenizer splits in two, with the length of the first part.
SPLIT_WORDS = {"cannot": 3, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "wanna": 3}

# Fixed value: description item left out of the item correlation.
MISLEADING_ITEMS = ["Is Discontinued By Manufacturer"]
