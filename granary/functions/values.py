"""Word lists, patterns and formats that results depend on."""

# --- fixed values ---
STANCES = ("true", "false", "neutral")
AUTHORS = ("human", "llm")
DEPENDENCE_LEVELS = ("H0", "D0", "D2", "D3", "D4")
SHAPES = ("organic", "targeted")
#: in the order in which the test log numbers them; elsewhere only membership counts
CELLS = ("H_T", "H_F", "H_N", "A_T", "A_F", "A_C", "G_F", "C_F")
EDIT_TYPES = ("date_shift", "number_perturb", "entity_swap")
SOURCE_PREFIXES = ("nq:", "trivia:")
NO_ANSWER = ("", "unknown", "not stated", "no answer", "none", "n a", "not mentioned", "i don t know", "unanswerable", "not given", "cannot be determined")
ANSWER_PREFIX = r"^(?:(?:the )?answer(?: is)?|it is|it was|is)\s+"
YEAR = r"(1[0-9]{3}|20[0-2][0-9])"
UNIT = r"\d\s*(ft|in|cm|mm|km|kg|lb|lbs|oz|m)\b"
NAME_PLUS_YEAR = r"^[A-Za-z]+ \d{4}$"
#: Where a text is cut into sentences: after a mark and white space; or with a capital, quote or bracket behind, and at line ends.
SENTENCE_END = r"(?<=[.!?])\s+"
SENTENCE_END_STRICT = r"(?<=[.!?])\s+(?=[A-Z\"'(\[])|\s*\n+\s*"
#: Bold, headings and rules tell that a text has markdown.
MARKDOWN = (r"(?s)\*\*(.+?)\*\*|__(.+?)__", r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$")
#: Markup and what stays of it, in the order in which it goes.
MARKDOWN_STEPS = (
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?s)\*\*(.+?)\*\*|__(.+?)__", "$1$2"),
    (r"(?<![\w*])\*(?!\s)([^*\n]+?)(?<!\s)\*(?!\w)|(?<![\w_])_(?!\s)([^_\n]+?)(?<!\s)_(?!\w)", "$1$2"),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", ""),
    (r"(?m)^[ \t]*(?:[-*•]|\d+[.)])[ \t]+", ""),
    (r"[ \t]+\n", "\n"),
)
#: Up to two capitalised names before a value, so that a whole name is replaced and not just the surname.
NAME_RUN = r"(?-i:(?:\b[A-Z][a-z]+\.?[ \t]+){0,2})"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
GENERIC_TOKENS = (
    "disambiguation", "state", "region", "city", "county", "country", "division", "innovation", "neighborhoods", "neighbourhoods", "greek", "latin", "maps", "conundrum", "islands",
    "games", "character", "origin", "topic", "category", "list", "overview", "history",
)
STOP_WORDS = ("the a an of in on at to for and or is was were are be by with from as that this which who whom whose what when where why how did does do has have had it its his her their he she they you we i").split()
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will "
    "would who so no which what about out up its into than them then some could time these two may only other new do any very like should over such after most also made many before must "
    "through back years where much your way well down"
).split()
MINHASH_PRIME = 4294967291
SCORE = r"(?i)Credibility Score\**\s*[:=]?\s*\**\s*(\d+)(?:\s*/\s*10)?"
SCORE_LOOSE = r"(?i)\bscore\b(?:(?!from|between|ranging)[^0-9\n]){0,25}?(\d{1,2})\b(?!\s*(?:to|-|–)\s*\d)(?:\s*/\s*10)?"
NEWS_PREFIX = r"(?i)^\s*CNN news:"
CONTRAST = r"(?i)\brather than\b|\bnot\b[^.]{0,60}\bbut\b|\binstead of\b|\bcontrary to\b"
TEMPLATES = (
    r"\bthe answer\b", r"\bis indeed\b", r"\bit is clear\b", r"\btherefore\b", r"\brather than\b", r"\bin fact\b", r"\bsafe to say\b", r"\bcorrect answer\b",
    r"\bnot \w+(?: \w+){0,3},? but\b", r"\baccording to\b", r"\bthe question\b",
)
SOURCE_TAG = r"(?i)^\s*(CNN news|According to|Reports? |A recent|An? \w+ (report|archive|database|guide|retrospective|catalogue|summary|profile|timeline|feature|article))"
REFUSALS = (
    "i cannot", "i can't", "i'm sorry", "i am sorry", "as an ai", "i'm unable", "i am unable", "misinformation", "not accurate", "factually incorrect", "hypothetical scenario",
    "instructed to", "as requested", "as you requested", "for the purpose of this", "for the purposes of this", "disclaimer",
)
META_MARKERS = (
    "hypothetical scenario", "purely hypothetical", "this hypothetical", "counterfactual scenario", "counterfactual passage", "in this scenario", "in this exercise", "for this exercise",
    "for this specific passage", "for the sake of this", "instructed to", "as requested", "as you requested", "as instructed", "for the purpose of this", "for the purposes of this",
    "to fulfill the task", "to fulfil the task", "serves our purpose", "we are constructing", "we will adhere", "adhere to the given", "the given fact", "the stated fact", "the false claim",
    "the incorrect claim", "this statement is incorrect", "this statement is false", "this statement is not accurate", "this assertion is incorrect", "this assertion is false",
    "this claim is incorrect", "this claim is false", "is not accurate", "would be incorrect", "this erroneous", "erroneous claim", "erroneous statement", "erroneous assertion",
    "erroneous attribution", "needs correction", "requires correction", "this belief is based on", "let's confidently", "confidently state", "state and support", "is historically inaccurate",
    "historically inaccurate", "disclaimer", "in reality,", "incorrect information", "incorrectly attribut", "conception error", "given incorrect", "unsupported by historical", "fabricated",
)
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
LEVEL_RANK = {"D2": 0, "D3": 1, "D4": 2, "D0": 3, "H0": 4}
#: condition -> cells with their number of documents; "k" stands for the condition's own number
RECIPES = {
    "clean": (("H_T", 1), ("A_T", 2)),
    "shortcut": (("H_T", 1), ("A_F", "k")),
    "ai_true_human_false": (("A_T", 2), ("H_F", 1)),
    "all_ai_mixed": (("A_T", 2), ("A_F", 2)),
    "all_human": (("H_T", 1), ("H_F", 1)),
    "independent": (("H_T", 1), ("A_T", 1), ("A_F", "k")),
    "coordinated": (("H_T", 1), ("A_T", 1), ("C_F", "k")),
    "shortcut_cram": (("H_T", 1), ("G_F", "k")),
    "shortcut_contrast": (("H_T", 1), ("A_C", "k")),
}
LEXICON = {
    "overused_words": (
        "actually", "additionally", "align with", "crucial", "delve", "delves", "emphasizing", "enduring", "enhance", "enhances", "fostering", "garner", "highlight", "highlights",
        "interplay", "intricate", "intricacies", "key role", "landscape", "pivotal", "quietly", "showcase", "showcases", "showcasing", "tapestry", "testament", "underscore", "underscores",
        "valuable", "vibrant",
    ),
    "inflated_importance": (
        "stands as", "serves as", "is a testament", "is a reminder", "vital role", "significant role", "crucial role", "pivotal role", "pivotal moment", "key moment", "underscores its",
        "highlights its", "reflects broader", "symbolizing its", "ongoing legacy", "enduring legacy", "lasting legacy", "contributing to the", "setting the stage", "marking the",
        "shaping the", "represents a shift", "marks a shift", "turning point", "evolving landscape", "focal point", "indelible mark", "deeply rooted",
    ),
    "shallow_ing": (
        "highlighting", "underscoring", "emphasizing", "ensuring", "reflecting", "symbolizing", "contributing to", "cultivating", "fostering", "encompassing", "showcasing",
    ),
    "sales": (
        "boasts", "boasts a", "rich cultural", "rich history", "profound", "enhancing its", "exemplifies", "commitment to", "natural beauty", "nestled", "in the heart of", "groundbreaking",
        "renowned", "breathtaking", "must-visit", "stunning",
    ),
    "vague_sources": (
        "industry reports", "observers have", "experts argue", "experts believe", "experts say", "some critics argue", "several sources", "according to experts", "historians agree",
        "scholars agree",
    ),
    "deeper_truth": (
        "the real question is", "at its core", "in reality", "what really matters", "fundamentally", "the deeper issue", "the heart of the matter",
    ),
    "announcing": (
        "let's dive", "let's explore", "let's break this down", "here's what you need to know", "now let's look", "without further ado",
    ),
    "chatbot_leftovers": (
        "i hope this helps", "of course!", "certainly!", "you're absolutely right", "would you like", "want me to", "let me know", "here is a", "here's a", "in this article",
        "in this passage", "this passage",
    ),
    "knowledge_disclaimers": (
        "as of my last", "up to my last training", "based on available information", "not publicly available", "it is believed that", "while specific details are limited",
        "readily available sources", "it is important to note", "it's important to note", "it is worth noting", "worth noting that",
    ),
    "filler": (
        "in order to", "due to the fact that", "at this point in time", "in the event that", "has the ability to",
    ),
    "qualifiers": (
        "to be fair", "it's also possible", "could potentially", "might arguably", "in some cases it may",
    ),
    "formulaic_endings": (
        "the future looks bright", "exciting times lie ahead", "journey toward", "step in the right direction", "continues to thrive", "continue to inspire", "continues to captivate",
        "continue to captivate",
    ),
    "fake_candid": (
        "honestly?", "here's the thing", "the thing is", "let's be honest", "real talk",
    ),
}
LEXICON_PATTERNS = {
    "not_x_but_y": r"\bnot (?:only|just|merely|simply)\b.{3,80}?\bbut\b",
    "dashes": r"[—–]|\s--\s",
    "bold_markdown": r"\*\*[^*]+\*\*",
    "heading_markdown": r"(?m)^\s*#{1,6}\s",
    "groups_of_three": r"\b[\w-]+, [\w-]+,? and [\w-]+\b",
    "hyphen_pairs": r"\b(?:third-party|cross-functional|client-facing|data-driven|decision-making|well-known|high-quality|real-time|long-term|end-to-end|state-of-the-art|cutting-edge|far-reaching|ever-evolving|game-changing|world-renowned|time-honored)\b",
    "from_x_to_y": r"\bfrom [\w\s]{2,40}? to [\w\s]{2,40}?, from\b",
}
NEGATED_BEFORE = (
    "not ", "rather than", "instead of", "isn't", "wasn't", "aren't", "weren't", "than ", "contrary to", "no ", "never", "unlike", "although", "while ", "despite", "even though", "though",
    "as opposed to", "previously", "believed", "thought", "commonly", "widely", "often", "mistaken", "misconception", "some may", "some sources", "claim", "supposed", "so-called", "allegedly",
    "incorrect", "wrong", "false", "myth", "belief", "confus",
)
NEGATED_AFTER = (
    "is incorrect", "is wrong", "is a misconception", "is false", "was not", "did not", "is not", "is a myth", "is mistaken", "is a common", "is often", "is widely", "is commonly", "does not",
    "has been mistaken", "may be", "actually", "in fact", "however",
)
AFFIRMED_BEFORE = ("actually", "in fact", "indeed", "correct answer is", "the truth is", "really", "important to note that", "truly", "in reality", "the real", "it was", "it is")
GENERIC_NOUNS = (
    "Doctrine Bowl County River Award Awards Prize University City Kingdom Party Company Corporation Band Series Film Movie Show Song Album War Battle Treaty Act Bill Team Club League Cup "
    "Championship Games Island Islands Mountain Mountains Ocean Sea Lake Street Avenue Road Bridge Tower Building Palace Castle Church Cathedral Museum School College Hospital Airport Station "
    "Park Square Empire Republic Union State States Province Region District Valley Desert Forest Bay Canal Railway Line Day Night House Hall Center Centre Institute Group Family Brothers "
    "Sisters Coast Beach Point Falls Hills Heights Gardens Fields Ranch Farm Store Shop Market Hotel Theatre Theater Stadium Arena Temple Abbey Fort Harbor Harbour Port Trail Route Highway "
    "Tunnel Bank Society Association Foundation Council Committee Commission Agency Department Ministry Office Court Parliament Congress Senate Army Navy Force Library Gallery Studio Records "
    "Pictures Network Radio Television Press Times Post Journal Magazine Book Novel Story Poem Symphony Opera Ballet Musical Play Saga Trilogy Wars Ring Rings Stone Stones Crown Man Woman Boy "
    "Girl King Queen Prince Princess Lord Lady Doctor Captain General President Airlines Motors Industries Systems Technologies Software"
).split()
_NOT = r"(?:not|never|n't|nor|isn't|wasn't|aren't|weren't)"
_ERR = r"(?:mistakenly|erroneously|falsely|wrongly|incorrectly)"
_VERBS = (
    r"(?:compos|writ|wrot|creat|direct|voic|play|starr|found|invent|discover|w[io]n|author|paint|record|releas|s[aiu]ng|design|buil|produc|ma[dk]e|scor|penn|nam|portray|perform|host|le[ad]|coach|own|"
    r"establish|develop|publish|appear|exist|ha[vd]|h[oe]ld|serv|bec[ao]me|receiv|earn|conduct|choreograph|form|start|launch|father|mother|marr|rul|reign|govern|preside)\w*"
)
#: name, pattern around the value {V}; a sentence's first that matches is its kind of denial
DENIALS = (
    ("not_by", _NOT + r"\s+(?:(?!by\b|but\b)[\w'-]+\s+){0,5}?by\s+(?:the\s+)?(?:\w+\s+){0,2}?{V}"),
    ("none_by", r"\b(?:none|neither|nothing)\b(?:(?!\bbut\b)[^.;]){0,40}?\bby\s+{V}"),
    ("not_value", r"\b" + _NOT + r"\s+(?!(?:just|only|merely|simply)\b)(?:(?:even|actually|really|the|a|an)\s+)*{V}(?!['’]s\b)"),
    ("not_work_of", r"\b" + _NOT + r"\s+(?:the\s+)?(?:work|creation|composition|invention|brainchild|product)\s+of\s+{V}"),
    ("no_evidence", r"\b(?:no|little|scant|without|lack of|lacks|lacking|absence of|nothing)\s+(?:\w+\s+){0,2}?(?:evidence|proof|record|records|documentation|indication|basis|source|sources|suggests|indicates)\b[^.;]{0,60}?{V}"),
    ("misattributed", r"\b(?:" + _ERR + r"\s+|mis)(?:attributed|credited|ascribed|assigned|identified|named|labeled|labelled)\s+(?:\w+\s+){0,3}?(?:to|as)\s+{V}"),
    ("value_is_wrong", r"{V}(?:'s)?\s+(?:\w+\s+){0,2}?(?:is|was|are|were|has been|have been|remains)\s+(?:often\s+|sometimes\s+|commonly\s+|widely\s+)?(?:" + _ERR + r"|never|disputed|unfounded|false|incorrect|wrong|inaccurate|unsupported|doubtful|a myth|a misconception)\b"),
    ("authorship_disputed", r"{V}'s\s+(?:authorship|involvement|role|claim|attribution|credit|contribution)\b[^.;]{0,40}?\b(?:is|was|are|were|remains|has been)\s+(?:disputed|doubtful|unfounded|questioned|contested|rejected|false|incorrect|wrong|a myth|a misconception|unsupported)\b"),
    ("value_is_not_role", r"{V}\s+(?:is|was|are|were)\s+not\s+(?:the\s+|a\s+|an\s+)?(?:\w+'s\s+)?(?:composer|author|creator|writer|director|voice|actor|artist|singer|inventor|discoverer|founder|winner|name|answer|one|person|man|woman|correct|right|real|true|actual|original)\b"),
    ("value_did_not_verb", r"{V}\s+(?:did not|didn't|never|does not|doesn't|has not|hasn't|had not|hadn't|could not|couldn't|cannot|can't|would not|wouldn't)\s+(?:\w+\s+){0,2}?" + _VERBS),
    ("myth_that", r"\b(?:myth|misconception|rumou?r|legend|falsehood|false claim|false belief|error)\s+that\s+{V}"),
    ("supposedly", r"\b(?:supposedly|allegedly|purportedly|so-called)\s+(?:\w+\s+){0,3}?{V}"),
)
# --- end of fixed values ---
