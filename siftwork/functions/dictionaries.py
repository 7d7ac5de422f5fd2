"""Word lists and patterns. All are parameters of the operators that use them.

Fixed values: they have to equal the agreed lists for right results, and stand
here as plain text in their natural order.
"""

from __future__ import annotations


def _listed(text: str) -> list[str]:
    return [w.strip() for w in text.replace("\n", " ").split(",") if w.strip()]


# Skills; multi-word ones first, so they win over their parts.
SKILLS = _listed("""
machine learning, deep learning, data science, data analysis, data engineering, computer vision,
power bi, google cloud, google ads, lean six sigma, six sigma, project management, product management,
stakeholder management, account management, business development, online marketing, content marketing,
social media, supply chain, customer service, office management, ux design, ui design, grafisch ontwerp,
people management, ci/cd, next.js, node.js, scikit-learn, c#, c++, .net,
javascript, typescript, python, java, golang, rust, php, ruby, kotlin, swift, scala, matlab, sql, nosql,
html, css, sass, react, angular, vue, svelte, express, django, flask, spring, laravel,
aws, azure, gcp, docker, kubernetes, terraform, ansible, jenkins, git, github, gitlab, devops, linux,
postgresql, mysql, mongodb, oracle, redis, elasticsearch, kafka, spark, hadoop, airflow, dbt, snowflake, databricks,
tableau, looker, excel, vba, sap, salesforce, dynamics, hubspot, jira, confluence, servicenow, workday,
statistics, nlp, tensorflow, pytorch, pandas, numpy, llm,
scrum, agile, kanban, prince2, pmp, itil, lean, safe,
projectmanagement, programmamanagement, productmanagement, accountmanagement, sales, verkoop, acquisitie, marketing,
seo, sea, sem, copywriting, communicatie,
recruitment, werving, selectie, sourcing, hrm, personeelszaken, payroll, salarisadministratie, arbeidsrecht,
finance, financiën, boekhouding, accounting, controlling, audit, fiscaliteit, ifrs, gaap, budgettering,
inkoop, procurement, logistiek, planning, warehouse, voorraadbeheer, transport,
klantenservice, callcenter, receptie, administratie, secretariaat,
juridisch, legal, compliance, privacy, avg, gdpr, contractmanagement,
figma, sketch, photoshop, illustrator, indesign,
autocad, solidworks, revit, bim, werktuigbouwkunde, elektrotechniek, installatietechniek, plc,
verpleegkunde, begeleiding, ggz, jeugdzorg, onderwijs, coaching, training,
leidinggeven, teamleider
""")

# Places.
CITIES = _listed("""
amsterdam, rotterdam, den haag, the hague, 's-gravenhage, utrecht, eindhoven, groningen, tilburg, almere,
breda, nijmegen, apeldoorn, haarlem, arnhem, enschede, amersfoort, zaanstad, zaandam, den bosch, 's-hertogenbosch,
haarlemmermeer, hoofddorp, zwolle, zoetermeer, leiden, maastricht, dordrecht, ede, alphen aan den rijn,
leeuwarden, alkmaar, emmen, westland, delft, venlo, deventer, sittard, helmond, oss, hilversum, heerlen,
amstelveen, roosendaal, purmerend, schiedam, lelystad, spijkenisse, vlaardingen, gouda, hoorn, assen,
bergen op zoom, capelle aan den ijssel, veenendaal, katwijk, zeist, nieuwegein, hengelo, roermond, den helder,
doetinchem, middelburg, vlissingen, harderwijk, weert, kampen, woerden, houten, barneveld, diemen, rijswijk,
brussel, brussels, antwerpen, antwerp, gent, ghent, brugge, leuven, mechelen, hasselt, genk, luik, liège,
namen, charleroi, kortrijk, aalst, oostende,
berlin, düsseldorf, keulen, köln, aachen, münchen, hamburg, frankfurt, london, paris, parijs, madrid,
barcelona, lisbon, lissabon, dublin, warsaw, warschau, krakow, bucharest, boekarest, sofia, istanbul
""")

# The region of the first two postcode digits, from 10 to 99.
POSTCODE_REGIONS = {
    10: "amsterdam", 11: "amsterdam", 12: "hilversum", 13: "almere", 14: "purmerend", 15: "zaandam",
    16: "hoorn", 17: "den helder", 18: "alkmaar", 19: "haarlem", 20: "haarlem", 21: "hoofddorp",
    22: "leiden", 23: "leiden", 24: "alphen aan den rijn", 25: "den haag", 26: "delft", 27: "zoetermeer",
    28: "gouda", 29: "capelle aan den ijssel", 30: "rotterdam", 31: "schiedam", 32: "spijkenisse", 33: "dordrecht",
    34: "nieuwegein", 35: "utrecht", 36: "utrecht", 37: "zeist", 38: "amersfoort", 39: "veenendaal",
    40: "tiel", 41: "culemborg", 42: "gorinchem", 43: "middelburg", 44: "goes", 45: "terneuzen",
    46: "bergen op zoom", 47: "roosendaal", 48: "breda", 49: "oosterhout", 50: "tilburg", 51: "tilburg",
    52: "den bosch", 53: "oss", 54: "uden", 55: "eindhoven", 56: "eindhoven", 57: "helmond",
    58: "venlo", 59: "venlo", 60: "weert", 61: "sittard", 62: "maastricht", 63: "heerlen",
    64: "heerlen", 65: "nijmegen", 66: "wijchen", 67: "ede", 68: "arnhem", 69: "arnhem",
    70: "doetinchem", 71: "winterswijk", 72: "zutphen", 73: "apeldoorn", 74: "deventer", 75: "enschede",
    76: "almelo", 77: "hardenberg", 78: "emmen", 79: "hoogeveen", 80: "zwolle", 81: "raalte",
    82: "lelystad", 83: "emmeloord", 84: "heerenveen", 85: "joure", 86: "sneek", 87: "bolsward",
    88: "harlingen", 89: "leeuwarden", 90: "leeuwarden", 91: "dokkum", 92: "drachten", 93: "groningen",
    94: "assen", 95: "stadskanaal", 96: "hoogezand", 97: "groningen", 98: "groningen", 99: "delfzijl",
}

# Languages with their spellings.
LANGUAGES = {
    "Dutch": _listed("nederlands, dutch, niederländisch, néerlandais, vlaams, flemish"),
    "English": _listed("engels, english, englisch, anglais"),
    "German": _listed("duits, german, deutsch, allemand"),
    "French": _listed("frans, french, französisch, français, francais"),
    "Spanish": _listed("spaans, spanish, spanisch, espagnol, español"),
    "Italian": _listed("italiaans, italian, italienisch, italien"),
    "Portuguese": _listed("portugees, portuguese, portugiesisch"),
    "Polish": _listed("pools, polish, polnisch, polski"),
    "Turkish": _listed("turks, turkish, türkisch, türkçe"),
    "Arabic": _listed("arabisch, arabic, arabe"),
    "Romanian": _listed("roemeens, romanian, română"),
    "Russian": _listed("russisch, russian, russe"),
    "Ukrainian": _listed("oekraïens, oekraiens, ukrainian"),
    "Chinese": _listed("chinees, chinese, mandarijn, mandarin"),
    "Hindi": ["hindi"],
    "Papiamento": _listed("papiamento, papiaments"),
}

# Stop words by language.
STOPWORDS = {
    "Dutch": _listed("de, het, een, en, van, ik, in, op, met, voor, bij, als, zijn, werkzaamheden, ervaring, jaar"),
    "English": _listed("the, and, of, to, in, with, for, as, my, at, experience, responsible, years"),
    "German": _listed("und, der, die, das, mit, für, bei, ich, von, erfahrung, jahre"),
    "French": _listed("et, le, la, les, des, pour, avec, dans, expérience, ans"),
}
# Further words that do not make a phrase worth comparing.
PHRASE_STOPWORDS = sorted({w for ws in STOPWORDS.values() for w in ws} | set(_listed("a, an, or, on, is, are, be, we, you, your, our, will, this, that, om, te, je, wij, jij, zijn, ben, bent, heb, hebt, of, die, dat, als, door, naar, aan, ook")))

# Phrases frequent in generated prose.
STOCK_PHRASES = _listed("""
leverage, leveraging, leveraged, spearheaded, spearheading, proven track record, results-driven, results driven,
dynamic, fast-paced, fast paced, passionate about, delve, seamless, seamlessly, synergy, synergies,
cutting-edge, cutting edge, innovative solutions, detail-oriented, highly motivated, self-starter, go-getter,
thrive, thrives, thriving, foster, fostering, fostered, robust, holistic, meticulous, meticulously,
adept at, adept in, showcasing, showcase, pivotal, instrumental in, orchestrated, streamlined, streamlining,
navigate, navigating, landscape, ever-evolving, tapestry, realm, furthermore, moreover, in summary,
strong communication skills, excellent communication skills, team player, commitment to excellence,
drive impactful, impactful, actionable insights, stakeholder engagement, value-driven, customer-centric,
i am excited to, i am confident that, eager to contribute, make a meaningful impact, unwavering,
i am writing to express my interest, i am thrilled to, ideal fit, align perfectly, aligns perfectly, i look forward to the opportunity to discuss, valuable asset to your team,
met veel enthousiasme solliciteer ik, sluit naadloos aan, ideale kandidaat,
proactive mindset, proactive attitude, measurable results, data-driven insights, what distinguishes me,
what sets me apart, take ownership, i would welcome the opportunity, thank you for considering my application,
thank you for your time and consideration, positive attitude, engaging customer experiences, continue growing professionally,
grow professionally, fresh ideas, meaningful projects, creative thinking, connect with audiences, strong work ethic,
turn ideas into, changing priorities, successful outcomes, work collaboratively, working collaboratively,
i am particularly interested, contribute to your team, innovative campaigns, innovative marketing strategies,
excellent interpersonal skills, hit the ground running, wealth of experience, unique blend, passion for,
willingness to learn, continuous improvement, i am confident in my ability,
aantoonbare resultaten, meetbare resultaten, proactieve houding, uitdagende functie, mijn passie voor,
gedreven, resultaatgericht, resultaatgerichte, proactief, proactieve, dynamische omgeving, in een dynamische,
passie voor, gepassioneerd, teamspeler, oplossingsgericht, klantgericht, klantgerichte, stressbestendig,
communicatief vaardig, sterke communicatieve vaardigheden, analytisch sterk, hands-on mentaliteit,
bewezen staat van dienst, toegevoegde waarde, naadloos, naadloze, synergie, innovatieve oplossingen,
ik ben ervan overtuigd, met veel enthousiasme, graag bijdragen, een waardevolle bijdrage, betekenisvolle impact,
daarnaast, bovendien, kortom, zorgvuldig, nauwgezet, veerkrachtig, scherp oog voor detail
""")

# Patterns of text that should not survive into a finished document.
PLACEHOLDERS = [
    r"\[(company|bedrijfs?naam|naam bedrijf|your name|uw naam|jouw naam|naam|job title|functietitel|date|datum|city|stad|phone|telefoon|email|e-mail)[^\]]*\]",
    r"\bas an ai( language model)?\b",
    r"\bals (een )?ai(-taalmodel)?\b",
    r"\b(here is|hier is) (a|an|your|je|uw|een) (tailored |aangepaste )?(cv|resume|résumé|cover letter|motivatiebrief)\b",
    r"\b(certainly|sure)!? here('s| is)\b",
    r"\bzeker!? hier (is|volgt)\b",
    r"\bfictional example\b",
    r"\b(details|achievements|experience)[^.\n]{0,60}\bare placeholders\b",
    r"linkedin\.com/in/(your-?name|yourname|firstname-?lastname)\b",
    r"\blorem ipsum\b",
    r"\{\{?\s*\w+\s*\}?\}",
    r"\bxx+(/|-)xx+\b",
]

# Makers named in file metadata, and marks of automatic tools.
GENERATORS = r"(chatgpt|openai|gpt-?\d|claude|gemini|bard|copilot|kickresume|rezi|resume\.io|zety|enhancv|teal|resumeworded|novoresume|cvmaker|jobscan|careerflow|huntr|wonsulting|aiapply|lazyapply|simplify)"
AUTO_SENDERS = r"(lazy ?apply|ai ?apply|sonara|job ?copilot|massive\.?app|loopcv|jobhire|simplify ?(copilot|jobs)?|bulk ?apply|auto[- ]?apply|apply ?pilot|jobright|jobsolv|wonsulting|careerflow|huntr)"
TAILORED_FILES = r"(tailor|optimi[sz]ed|ats[-_ ]?(friendly|optimi[sz]ed|ready)|for[-_ ]?(the[-_ ]?)?(job|vacancy|role|position)|job[-_ ]?match)"
TAILORED_TEXT = [
    r"\bats[- ]?(friendly|optimi[sz]ed|compliant|ready)\b",
    r"\btailored (to|for) (this|the|your) (role|position|job|vacancy|opening)\b",
    r"\boptimi[sz]ed for (ats|the job description|this (role|position|vacancy))\b",
    r"\b(based on|matching) the job description\b",
    r"\bafgestemd op (deze|de) vacature\b",
]

# American and British spellings.
_IZE = "organi|optimi|recogni|prioriti|speciali|reali|summari|utili|maximi|minimi|customi|standardi|visuali|finali|emphasi|mobili|categori|digitali"
AMERICAN = rf"\b(?:(?:{_IZE})z(?:e|ed|es|ing|ation|ations)|analyz(?:e|ed|es|ing)|(?:colo|behavio|favo|hono)rs?|centers?)\b"
BRITISH = rf"\b(?:(?:{_IZE})s(?:e|ed|es|ing|ation|ations)|analys(?:e|ed|es|ing)|(?:colo|behavio|favo|hono)urs?|centres?|learnt|programmes?)\b"

# Month names and words for today.
MONTHS = {
    1: _listed("jan, januari, january"), 2: _listed("feb, februari, february"), 3: _listed("mrt, maart, mar, march"), 4: _listed("apr, april"),
    5: _listed("mei, may"), 6: _listed("jun, juni, june"), 7: _listed("jul, juli, july"), 8: _listed("aug, augustus, august"), 9: _listed("sep, sept, september"),
    10: _listed("okt, oct, oktober, october"), 11: _listed("nov, november"), 12: _listed("dec, december"),
}
TODAY_WORDS = "heden|present|nu|now|current|huidig|today|current|actueel|lopend|ongoing|heute"

# Number words of experience claims.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15, "twenty": 20,
    "een": 1, "twee": 2, "drie": 3, "vier": 4, "vijf": 5, "zes": 6, "zeven": 7, "acht": 8, "negen": 9, "tien": 10, "twaalf": 12, "vijftien": 15, "twintig": 20,
}

# Words that say nothing in a title.
TITLE_NOISE = _listed("the, a, an, and, of, for, at, in, to, with, de, het, een, en, van, voor, bij, als, naar, op, in, m, v, x, h, f, mv, parttime, fulltime, part, full, time, uur, hours, per, week, position, role, vacancy, job, functie, vacature, positie, baan, nl, amp")

# Named character references that are decoded.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "euro": "€", "eacute": "é", "euml": "ë", "iuml": "ï", "ouml": "ö", "uuml": "ü", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•", "amp": "&"}

# Word endings, in the order they are tried.
ENDINGS = _listed("ments, ment, ers, ing, es, er, ed, en, s")

# Sites that are read from an open tab only, and query parameters that only track.
TAB_ONLY = r"(^|\.)(linkedin\.com|indeed\.[a-z.]+|glassdoor\.[a-z.]+|werk\.nl|nationalevacaturebank\.nl|werkzoeken\.nl|stepstone\.[a-z.]+|intermediair\.nl|monsterboard\.nl|jooble\.org|adzuna\.[a-z.]+|jobbird\.com)$"
TRACKING = r"^(utm_.*|trk|trkinfo|ref|refid|referrer|trackingid|from|src|source|position|pagenum|origin|gclid|fbclid|mc_[a-z]+|sid|lipi)$"

# Preset sources.
PRESETS = [
    ("LinkedIn Jobs", "https://www.linkedin.com/jobs/search/?keywords={q}&location={city}"),
    ("Indeed", "https://nl.indeed.com/jobs?q={q}&l={city}"),
    ("Werk.nl (UWV)", "https://www.werk.nl/werkzoekenden/vacatures/?zoekterm={q}&locatie={city}"),
    ("Nationale Vacaturebank", "https://www.nationalevacaturebank.nl/vacature/zoeken?query={q}&location={city}"),
    ("Werkzoeken.nl", "https://www.werkzoeken.nl/vacatures/?what={q}&where={city}"),
    ("StepStone", "https://www.stepstone.nl/vacatures/{q}/in-{city}"),
    ("Intermediair", "https://www.intermediair.nl/vacatures?query={q}"),
    ("Glassdoor", "https://www.glassdoor.nl/Vacature/index.htm?sc.keyword={q}"),
    ("Jobbird", "https://www.jobbird.com/nl/vacature?s={q}"),
    ("YoungCapital", "https://www.youngcapital.nl/vacatures?search%5Bkeywords_scope%5D={q}"),
]
