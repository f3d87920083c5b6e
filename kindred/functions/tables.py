"""Fixed values of the record-matching features: word lists, abbreviations and spellings that results depend on."""

from __future__ import annotations

# Fixed values.
LEGAL = tuple(
    "private pvt limited ltd llp llc inc incorporated corp corporation co company plc lp pllc pc pa sarl sas sa sasu eurl sci snc gmbh ag the and of "
    "pra li lt pte opc ms m s cie ste et de du des la le les dba".split()
)
NOISE = tuple(
    "services service enterprises enterprise group solutions solution center centre industries industry trading traders holdings associates agency "
    "consultants consultancy systems technologies technology tech ventures partners com www net org in co shop store stores sons".split()
)
SPELLED_LEGAL = r"^(?:pr+a*[iy]?[bv]h?[ae]+t+[a]?|l[iy]m[iy]t+e*d+[a]?|priv[ae]t|limit[ae]d|pvt|ltd)$"
#: Spellings that fold together in the consonant skeleton, in this order, and single letters.
DIGRAPHS = {"ph": "f", "bh": "v", "th": "t", "dh": "d", "kh": "k", "gh": "g", "ch": "c", "sh": "s", "jh": "j", "ck": "k", "qu": "k"}
LETTERS = ("bwzqxc", "vvjkkk")
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware",
    "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky",
    "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri",
    "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "newhampshire", "nj": "newjersey", "nm": "newmexico", "ny": "newyork", "nc": "northcarolina",
    "nd": "northdakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhodeisland", "sc": "southcarolina",
    "sd": "southdakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "westvirginia",
    "wi": "wisconsin", "wy": "wyoming", "dc": "districtofcolumbia",
}
INDIAN_STATES = {
    "dl": "delhi", "mh": "maharashtra", "ka": "karnataka", "tn": "tamilnadu", "up": "uttarpradesh", "wb": "westbengal", "gj": "gujarat", "rj": "rajasthan",
    "mp": "madhyapradesh", "ap": "andhrapradesh", "ts": "telangana", "tg": "telangana", "kl": "kerala", "pb": "punjab", "hr": "haryana", "od": "odisha",
    "or": "odisha", "orissa": "odisha", "br": "bihar", "jh": "jharkhand", "cg": "chhattisgarh", "ct": "chhattisgarh", "as": "assam", "uk": "uttarakhand",
    "ut": "uttarakhand", "hp": "himachalpradesh", "ga": "goa", "jk": "jammukashmir", "ch": "chandigarh", "py": "puducherry", "pondicherry": "puducherry",
}
#: Codes that are also everyday words stand for no state.
AMBIGUOUS_CODES = tuple("de la in me or hi id ok al co as oh ne pa ga ms ch no".split())
STATE_PHRASES = {
    "tamil nadu": "tamilnadu", "uttar pradesh": "uttarpradesh", "west bengal": "westbengal", "madhya pradesh": "madhyapradesh",
    "andhra pradesh": "andhrapradesh", "himachal pradesh": "himachalpradesh", "jammu and kashmir": "jammukashmir", "jammu kashmir": "jammukashmir",
    "new york": "newyork", "new jersey": "newjersey", "new mexico": "newmexico", "new hampshire": "newhampshire", "north carolina": "northcarolina",
    "south carolina": "southcarolina", "north dakota": "northdakota", "south dakota": "southdakota", "west virginia": "westvirginia",
    "rhode island": "rhodeisland", "district of columbia": "districtofcolumbia",
}
CITIES = {
    "calcutta": "kolkata", "bombay": "mumbai", "madras": "chennai", "bengaluru": "bangalore", "gurugram": "gurgaon", "poona": "pune",
    "trivandrum": "thiruvananthapuram", "baroda": "vadodara",
}
STREETS = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "avn": "avenue", "rd": "road", "dr": "drive", "drv": "drive", "ct": "court",
    "cv": "cove", "pkwy": "parkway", "pky": "parkway", "blvd": "boulevard", "bd": "boulevard", "bld": "boulevard", "ln": "lane", "pl": "place",
    "cir": "circle", "hwy": "highway", "sq": "square", "ter": "terrace", "terr": "terrace", "trl": "trail", "fl": "floor", "flr": "floor",
    "apt": "apartment", "ste": "suite", "no": "number", "nos": "number", "bldg": "building", "nr": "near", "opp": "opposite", "r": "rue", "ch": "chemin",
    "imp": "impasse", "all": "allee", "fbg": "faubourg", "rte": "route", "pt": "point", "mt": "mount", "ft": "fort", "n": "north", "s": "south",
    "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "hts": "heights", "jn": "junction",
    "jct": "junction", "cres": "crescent", "sec": "sector", "ph": "phase", "extn": "extension", "ext": "extension",
}
#: Endings of web addresses, and legal forms that initials leave out.
DOMAIN_WORDS = ("www", "com", "net", "org", "in", "co", "biz", "info", "fr", "us")
INITIAL_STOPS = ("corp", "inc", "llc", "ltd", "llp", "pvt", "limited", "private", "the")
DOMAIN = r"\.(com|net|org|in|co|biz|info|fr|us)\b|www"
#: The canonical name and address: legal forms, and street words (an empty one goes).
CANONICAL_LEGAL = tuple(
    "sarl sas sasu eurl sa sci snc scop scs sca selarl sem gie cie compagnie fils societe ste llc inc incorporated ltd limited pvt private corp "
    "corporation co company plc llp lp pllc pc".split()
)
CANONICAL_STREETS = {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "blvd": "boulevard", "all": "allee", "pl": "place", "imp": "impasse", "ch": "chemin",
    "rte": "route", "qu": "quai", "crs": "cours", "sq": "square", "st": "street", "rd": "road", "dr": "drive", "ln": "lane", "ct": "court", "hwy": "highway",
    "pkwy": "parkway", "n": "", "no": "", "and": "et", "&": "et",
}
REGIONS = tuple("hauts de france pays la loire nouvelle aquitaine nord gironde atlantique pas calais".split())
