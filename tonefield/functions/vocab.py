"""Controlled vocabularies."""

from __future__ import annotations

# Labels, scales and word lists that results depend on.
SENTIMENTS = ("Negative", "Neutral", "Positive")
POLARITY = {"Negative": 2.0, "Neutral": 4.0, "Positive": 6.0}
LABEL_ALIASES = {"negative": "Negative", "neg": "Negative", "neutral": "Neutral", "neu": "Neutral", "positive": "Positive", "pos": "Positive"}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1, "none": 0}
MAX_TARGET_WORDS = 15
WEAK_ENTITY_LABELS = ("DATE", "TIME", "CARDINAL", "ORDINAL", "PERCENT", "QUANTITY")
INSTITUTIONAL_MODIFIERS = ("white", "supreme", "united", "national", "federal", "state", "democratic", "republican", "u.s.", "us", "house", "senate")
OBJECT_FOCUSED_EVENTS = tuple(
    """acquire acquired buy bought purchase purchased launch launched introduce introduced announce announced impose imposed cut cuts
    raise raised reduce reduced increase increased approve approved ban banned sanction sanctioned invest invested""".split()
)
SUBJECT_FOCUSED_EVENTS = tuple(
    """be is was were are report reported speak spoke say said meet met visit visited rise rose fall fell climb climbed drop dropped
    compete competing discuss discussed""".split()
)
GENERIC_TERMS = tuple(
    """r,d,gop,ala.,ariz.,ark.,calif.,colo.,conn.,del.,fla.,ga.,ill.,ind.,kan.,ky.,la.,mass.,md.,mich.,minn.,miss.,mo.,mont.,neb.,nev.,okla.,ore.,pa.,tenn.,tex.,va.,vt.,wash.,wis.,wyo.,n.c.,n.d.,n.h.,n.j.,n.m.,n.y.,r.i.,s.c.,s.d.,w.va.,company,companies,firm,firms,people,officials,official,investors,investor,members,group,groups,organization,organizations,government,government officials,country,nation,the company,the firm,the organization,the government,the country,the nation,the situation,the agreement,the conference,the event,today,yesterday,tomorrow,this week,this month,this year""".split(",")
)
PRONOUNS = tuple(
    """it its he him his she her hers they them their theirs this that these those we us our ours i me my mine you your yours
    who whom whose which what""".split()
)
RANKER_PRONOUNS = tuple(
    """i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours ourselves
    they them their theirs themselves""".split()
)
HONORIFICS = tuple("mr mr. mrs mrs. ms ms. miss dr dr. prof prof. president senator sen. governor gov. rep rep. representative gen gen. general judge rev rev.".split())
COMMON_TARGET_WORDS = tuple(
    """company companies government president presidents minister ministers investor investors people public police official officials
    administration party parties market markets""".split()
)
MALE_PRONOUNS, FEMALE_PRONOUNS = ("he", "him", "his"), ("she", "her", "hers")
THING_TYPES = ("ORG", "GPE", "PRODUCT", "LAW", "NORP", "FAC", "MONEY")
PRONOUN_TYPES = {"it": THING_TYPES, "its": THING_TYPES, "he": ("PERSON",), "him": ("PERSON",), "his": ("PERSON",), "she": ("PERSON",), "her": ("PERSON",)}
GENERIC_HEAD_TYPES = {
    "company": ("ORG",), "companies": ("ORG",), "firm": ("ORG",), "firms": ("ORG",), "organization": ("ORG",), "organizations": ("ORG",),
    "government": ("ORG", "GPE"), "country": ("GPE",), "countries": ("GPE",), "nation": ("GPE",), "nations": ("GPE",),
}
DASHBOARD_OUTLETS = {"npr.org": "NPR", "bbci.co.uk": "BBC"}
SAMPLER_OUTLETS = {"feeds.npr.org": "NPR", "feeds.bbci.co.uk": "BBC", "www.thehindu.com": "The Hindu"}
EDGE_PUNCTUATION = ".,!?;:\"'()[]{}"
