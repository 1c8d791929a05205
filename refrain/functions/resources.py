"""Fixed values. No file is read at import; the lists that are too large to hold here are parameters."""

# Replacements of whole words, applied in this order.
SLANG = {
    "gonna": "going to",
    "wanna": "want to",
    "ain't": "is not",
    "lemme": "let me",
    "gotta": "got to",
    "'til": "until",
    "y'all": "you all",
    "imma": "i am going to",
    "kinda": "kind of",
    "outta": "out of",
    "lotta": "lot of",
    "dunno": "do not know",
    "wassup": "what is up",
    "yo": "you",
    "cuz": "because",
    "cause": "because",
}

# Words without content in lyrics.
FILLERS = (
    "yeah woo hey oh uh huh la na ooh ah yea mmm woah whoa ha yo uhh uuh aye bam 'm 're 've 'll 's 'd n't uhuh hahaha haha yay hm hmm whoo "
    "whooo heyya lalala tra ba shoo doo nah hihi woohoo booyah traa lala heya heyo pow ugh meh blah ow ouch snore hic burp ayy woop grr grrr "
    "tsk tsktsk uh-oh yohoo lalalala heyhey wooow boom zing laa dooo haaa yah ughh bleh bluh yawn brr oooh phew huhh lol omg"
).split()

# English stopwords, as widely published; another list can be given wherever stopwords are used.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers "
    "herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll "
    "m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Emotions of the lexicon and the groups they belong to.
GROUP_OF = {
    "joy": "love",
    "trust": "love",
    "positive": "love",
    "sadness": "sadness",
    "fear": "sadness",
    "negative": "sadness",
    "anger": "anger",
    "disgust": "anger",
    "anticipation": "hope",
    "surprise": "surprise",
}

# Weights of the groups in a score.
WEIGHTS = {"love": 1.0, "hope": 0.5, "sadness": -1.0, "anger": -1.0, "surprise": 0.0}

GROUPS = sorted(set(GROUP_OF.values()))

# Texts that a CSV field may hold for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Fixed value: the artist under which translated songs are listed, and the mark in their titles.
TRANSLATIONS_ARTIST = "Genius English Translations"
TRANSLATION_MARK = "English Translation"
