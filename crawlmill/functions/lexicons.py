"""Word lists and category keywords. They decide results, so keep them as they are."""

# fixed values
POSITIVE_WORDS = """
good great excellent amazing wonderful fantastic best love happy positive beautiful perfect brilliant
superb outstanding remarkable impressive delightful enjoy glad pleased satisfied helpful friendly
awesome nice fine success win advantage benefit improve growth gain profit progress innovation creative
efficient effective reliable strong exciting promising optimistic thriving exceptional superior
magnificent joyful grateful
""".split()

# fixed values
NEGATIVE_WORDS = """
bad terrible awful horrible worst hate ugly poor negative sad angry disappointing failure problem issue
broken useless waste difficult painful annoying boring confused frustrated worried afraid weak slow
expensive loss decline risk danger threat crisis damage harm error mistake fault flaw bug crash fail
reject complaint concern lacking inferior mediocre dreadful
""".split()

# fixed values, in tie-breaking order
CATEGORIES = """
technology business science health sports entertainment politics education finance general
""".split()

# fixed values
CATEGORY_KEYWORDS = {
    "technology": "software app code data ai computer digital tech algorithm api".split(),
    "business": "company market revenue startup enterprise strategy management profit".split(),
    "science": "research study experiment hypothesis theory lab discovery biology".split(),
    "health": "medical health doctor patient treatment disease wellness fitness".split(),
    "sports": "game team player score match championship athlete tournament".split(),
    "entertainment": "movie music show film artist concert performance media".split(),
    "politics": "government policy election vote law political congress senate".split(),
    "education": "school student learn teach university course training academic".split(),
    "finance": "investment stock bank trading fund portfolio financial currency".split(),
}

# fixed values: words never reported as topics
TOPIC_STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall
can to of in for on with at by from as into through during before after above below between and but or
not no nor so yet both either neither this that these those it its i me my we our you your he she they
them their what which who whom how when where why all each every if then than very just about up out
also
""".split()

# fixed values: words never reported as keywords
KEYWORD_STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall
can need dare ought used to of in for on with at by from as into through during before after above below
between out off over under again further then once and but or nor not so yet both each few more most
other some such no only own same than too very just because this that these those it its i me my we our
you your he him his she her they them their what which who whom
""".split()
