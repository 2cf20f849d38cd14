"""Word lists of the engine."""

from __future__ import annotations

# The public English stop word list of 198 words.
ENGLISH_STOPWORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
    she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
    these those am is are was were be been being have has had having do does did doing a an the and but if or because as
    until while of at by for with about against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain
    aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
    mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    he'd he'll he's i'd i'll i'm i've it'd it'll she'd she'll they'd they'll they're they've we'd we'll we're we've""".split()
)
# Words that carry meaning in the domain and stay, and generic words that go.
KEPT_WORDS = tuple(
    "not no nor never without against cannot should must can may might could would before after until off down up out more less only".split()
)
EXTRA_STOPWORDS = ("people", "person", "things", "information", "time", "et", "al")
CUSTOM_STOPWORDS = tuple(w for w in ENGLISH_STOPWORDS if w not in KEPT_WORDS) + EXTRA_STOPWORDS
# Words that count as negations and modals in reports.
NEGATIONS = ("not", "no", "nor", "never", "without", "against", "cannot")
MODALS = ("should", "must", "can", "may", "might", "could", "would")

# Stop words of the corpus diagnostics, function words that mark English, left-over phrases.
QC_STOPWORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below between both
    but by can could did do does doing down during each few for from further had has have having he her here hers him his
    how i if in into is it its itself just may me might more most must my no nor not now of off on once only or other our
    out over own same she should so some such than that the their them then there these they this those through to too
    under until up very was we were what when where which while who whom why will with would you your yours""".split()
)
ENGLISH_MARKS = tuple("the and of to a in is for you or that with are be it as your can on this if not may have".split())
LEFTOVER_PHRASES = ("skip to main content", "all rights reserved", "cookie", "subject to notice of rights", "javascript", "back to top")
# Words and parts of words that name a topic.
TOPIC_SEEDS = {
    "depression": ("depress", "low mood"),
    "anxiety": ("anxi", "panic", "worry"),
    "stress": ("stress",),
    "sleep": ("sleep", "insomnia"),
    "self_esteem": ("self-esteem", "self esteem", "confidence"),
    "loneliness": ("lonel", "isolat"),
    "grief": ("grief", "bereave"),
    "trauma": ("trauma", "ptsd", "post-traumatic"),
    "eating": ("eating", "anorexia", "bulimia", "binge"),
    "substance_use": ("alcohol", "drug", "substance"),
    "medication": ("medic", "antidepressant", "ssri", "dose", "prescri"),
    "self_harm": ("self-harm", "self harm", "harm yourself", "self-injur"),
    "suicide": ("suicid",),
    "crisis_services": ("crisis", "helpline", "988", "14416", "emergency"),
    "relationships": ("relationship", "partner"),
    "family": ("family", "parent"),
}
# Names of the domain by label; those of CASED match only as written.
ENTITIES = {
    "CONDITION": (
        "depression", "anxiety", "PTSD", "GAD", "OCD", "panic disorder", "bipolar disorder", "psychosis", "schizophrenia",
        "generalised anxiety disorder", "generalized anxiety disorder", "post-traumatic stress disorder",
        "obsessive-compulsive disorder", "social anxiety disorder", "alcohol use disorder", "eating disorder", "insomnia",
        "self-harm", "phobia",
    ),
    "MEDICATION": (
        "SSRI", "SSRIs", "SNRI", "antidepressant", "antidepressants", "benzodiazepine", "benzodiazepines", "sertraline",
        "fluoxetine", "escitalopram", "citalopram", "paroxetine", "mirtazapine", "venlafaxine", "duloxetine", "naltrexone",
        "acamprosate", "baclofen", "disulfiram", "diazepam",
    ),
    "THERAPY": (
        "CBT", "cognitive behavioural therapy", "cognitive behavioral therapy", "talking therapies", "interpersonal therapy",
        "psychotherapy", "counselling", "counseling", "guided self-help", "psychoeducation", "exposure therapy", "mindfulness",
    ),
    "ORG": ("NICE", "NHS", "WHO", "NIMH", "NIH", "SAMHSA", "MHRA", "FDA", "National Institute of Mental Health"),
}
CASED = frozenset(["WHO", "NICE", "GAD"])
HELPLINE = r"^(988|1-8\d\d-\d{3}-\d{4})$"
# Tags of words whose part of speech doesn't depend on context, and of shapes.
TAG_LEXICON = {
    "FW": ("e.g.", "i.e.", "etc."),
    "NNP": ("ptsd", "gad", "cbt", "ocd", "mhgap", "nhs", "nimh", "samhsa"),
    "NN": (
        "panic", "self-harm", "sertraline", "fluoxetine", "escitalopram", "citalopram", "paroxetine", "mirtazapine",
        "venlafaxine", "duloxetine", "naltrexone", "acamprosate", "baclofen", "disulfiram", "pregabalin", "lithium",
    ),
}
TAG_SHAPES = (
    (r"^\d+(\.\d+)?[–-]\d+(\.\d+)?$", "CD"),
    (r"^\d+(\.\d+){2,}$", "CD"),
    (r"^1-8\d\d-\d{3}-\d{4}$", "CD"),
    (r"^[A-Z]{2,}(-?\d+|-[IVX]+)$", "NNP"),
    (r"^[A-Z]{2,}s$", "NNS"),
    (r"^(https?://|www\.)|\.(org|gov|com|uk|int)\b", "NNP"),
)
# Lemmas that rules would get wrong.
LEMMA_EXCEPTIONS = {"media": "media", "generalised": "generalised", "generalized": "generalised"}
IRREGULAR_LEMMAS = {
    "children": "child", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "mice": "mouse", "lives": "life",
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "am": "be", "being": "be", "has": "have", "had": "have",
    "having": "have", "does": "do", "did": "do", "done": "do", "went": "go", "gone": "go", "felt": "feel", "slept": "sleep",
    "took": "take", "taken": "take", "gave": "give", "given": "give", "found": "find", "made": "make", "said": "say",
    "told": "tell", "got": "get", "came": "come", "saw": "see", "seen": "see", "knew": "know", "known": "know",
    "thought": "think", "better": "good", "best": "good", "worse": "bad", "worst": "bad",
}
