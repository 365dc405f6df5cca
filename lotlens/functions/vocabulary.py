"""Synonym tables of the market: makes, models, categories and cities, as literal map columns.

The tables are small and fixed, so a lookup is one map access in the same stage and never a join.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical make and the spellings sellers use for it
MAKES = {
    "MERCEDES-BENZ": ("mercedes", "mercedes benz", "mersedes", "merc", "benz", "mb", "мерседес", "мерседес бенц", "мерс"),
    "BMW": ("bmw", "bumer", "бмв", "бэмвэ"),
    "TOYOTA": ("toyota", "toyata", "тойота"),
    "LEXUS": ("lexus", "лексус"),
    "HYUNDAI": ("hyundai", "hunday", "hyndai", "хендай", "хундай", "хёндэ"),
    "KIA": ("kia", "киа", "кия"),
    "NISSAN": ("nissan", "nisan", "ниссан"),
    "HONDA": ("honda", "хонда"),
    "VOLKSWAGEN": ("volkswagen", "vw", "folksvagen", "фольксваген", "вольксваген"),
    "AUDI": ("audi", "ауди"),
    "OPEL": ("opel", "опель"),
    "FORD": ("ford", "форд"),
    "CHEVROLET": ("chevrolet", "chevy", "шевроле"),
    "MITSUBISHI": ("mitsubishi", "митсубиси", "мицубиси"),
    "MAZDA": ("mazda", "мазда"),
    "SUBARU": ("subaru", "субару"),
    "SKODA": ("skoda", "шкода"),
    "RENAULT": ("renault", "reno", "рено"),
    "PEUGEOT": ("peugeot", "пежо"),
    "CITROEN": ("citroen", "ситроен"),
    "FIAT": ("fiat", "фиат"),
    "VOLVO": ("volvo", "вольво"),
    "LAND ROVER": ("land rover", "landrover", "range rover", "rangerover", "ленд ровер", "рендж ровер"),
    "JEEP": ("jeep", "джип"),
    "PORSCHE": ("porsche", "порше"),
    "MINI": ("mini", "мини"),
    "INFINITI": ("infiniti", "инфинити"),
    "ACURA": ("acura", "акура"),
    "SSANGYONG": ("ssangyong", "ссангйонг", "санг йонг"),
    "SUZUKI": ("suzuki", "сузуки"),
    "DAEWOO": ("daewoo", "дэу", "деу"),
    "LADA": ("lada", "vaz", "ваз", "лада", "жигули"),
    "GAZ": ("gaz", "газ"),
    "UAZ": ("uaz", "уаз"),
    "TESLA": ("tesla", "тесла"),
    "BYD": ("byd", "бид"),
    "CHERY": ("chery", "чери"),
    "GEELY": ("geely", "джили"),
    "HAVAL": ("haval", "хавал"),
    "MG": ("mg", "мг"),
    "DACIA": ("dacia", "дачия"),
    "SEAT": ("seat", "сеат"),
    "JAGUAR": ("jaguar", "ягуар"),
    "CADILLAC": ("cadillac", "кадиллак"),
    "CHRYSLER": ("chrysler", "крайслер"),
    "DODGE": ("dodge", "додж"),
    "GMC": ("gmc",),
    "GENESIS": ("genesis", "генезис"),
    "ISUZU": ("isuzu", "исузу"),
    "IVECO": ("iveco",),
    "MAN": ("man",),
}

# Model names that are known by several spellings, by make
MODEL_ALIASES = {
    "BMW": {
        "5 SERIES": ("5 er", "5er", "5 series", "5"),
        "3 SERIES": ("3 er", "3er", "3 series", "3"),
        "7 SERIES": ("7 series", "7"),
    },
    "MERCEDES-BENZ": {
        "E-CLASS": ("e klasse", "e class"),
        "C-CLASS": ("c klasse", "c class"),
        "S-CLASS": ("s klasse", "s class"),
    },
    "VOLKSWAGEN": {"JETTA": ("jetta",), "CC": ("passat cc",)},
    "LADA": {"2107": ("2107",), "NIVA": ("niva",)},
}
MODEL_NOISE = "sedan|hetcbek|hatchback|universal|suv|crossover|coupe|kupe|avtomat|mexaniki|benzin|dizel|hibrid|full|tam"

# Category members and their spellings
FUELS = {
    "PETROL": ("benzin", "petrol", "gasoline", "бензин"),
    "DIESEL": ("dizel", "diesel", "дизель", "дт"),
    "HYBRID": ("hibrid", "hybrid", "гибрид"),
    "PLUGIN_HYBRID": ("plug in hibrid", "plugin hybrid", "plug in hybrid", "phev", "плагин гибрид"),
    "ELECTRIC": ("elektro", "elektrik", "electric", "ev", "электро", "электрический"),
    "LPG": ("qaz", "lpg", "benzin qaz", "газ", "пропан"),
    "CNG": ("cng", "metan", "метан"),
}
TRANSMISSIONS = {
    "MANUAL": ("mexaniki", "manual", "mexanika", "механика", "механическая", "mt"),
    "AUTOMATIC": ("avtomat", "automatic", "auto", "автомат", "автоматическая", "at"),
    "CVT": ("variator", "cvt", "вариатор"),
    "DCT": ("dsg", "dct", "pdk", "s tronic", "dual clutch"),
    "AMT": ("robotlasdirilmis", "robot", "amt", "робот", "роботизированная"),
}
DRIVETRAINS = {
    "FWD": ("on", "on oturucu", "front", "fwd", "передний", "передний привод"),
    "RWD": ("arxa", "arxa oturucu", "rear", "rwd", "задний", "задний привод"),
    "AWD": ("tam", "tam oturucu", "awd", "4wd", "4x4", "quattro", "xdrive", "4matic", "полный", "полный привод"),
}
# in order of precedence: the first that a description names wins
BODIES = {
    "MINIVAN": ("miniven", "minivan", "минивэн"),
    "VAN": ("furqon", "van", "mikroavtobus", "фургон", "микроавтобус"),
    "PICKUP": ("pikap", "pickup", "пикап"),
    "SUV": ("offroader", "off roader", "suv", "cip", "jeep", "внедорожник"),
    "CROSSOVER": ("krossover", "crossover", "кроссовер"),
    "WAGON": ("universal", "wagon", "estate", "универсал"),
    "LIFTBACK": ("liftbek", "liftback", "лифтбек"),
    "HATCHBACK": ("hetcbek", "hatchback", "хэтчбек", "хетчбек"),
    "CONVERTIBLE": ("kabriolet", "convertible", "roadster", "rodster", "кабриолет", "родстер"),
    "COUPE": ("kupe", "coupe", "купе"),
    "SEDAN": ("sedan", "седан"),
}
SELLERS = {
    "DEALER": ("diler", "dealer", "salon", "avtosalon", "дилер", "автосалон", "салон", "resmi numayende", "официальный представитель"),
    "PRIVATE": ("sexsi", "private", "owner", "sahibi", "частное", "частник", "собственник"),
    "IMPORTER": ("idxalci", "importer", "import", "импортер"),
}
CITIES = {
    "Bakı": ("baki", "baku", "баку"),
    "Sumqayıt": ("sumqayit", "sumgait", "sumgayit", "сумгаит", "сумгайыт"),
    "Gəncə": ("gence", "ganja", "gyandzha", "гянджа"),
    "Xırdalan": ("xirdalan", "khirdalan", "хырдалан"),
    "Mingəçevir": ("mingecevir", "mingachevir", "мингечевир"),
    "Şirvan": ("sirvan", "shirvan", "ширван"),
    "Naxçıvan": ("naxcivan", "nakhchivan", "нахчыван", "нахичевань"),
    "Lənkəran": ("lenkeran", "lankaran", "ленкорань"),
    "Şəki": ("seki", "sheki", "шеки"),
    "Yevlax": ("yevlax", "yevlakh", "евлах"),
    "Quba": ("quba", "guba", "куба"),
    "Şamaxı": ("samaxi", "shamakhi", "шемаха"),
    "Zaqatala": ("zaqatala", "zagatala", "загатала"),
    "Xaçmaz": ("xacmaz", "khachmaz", "хачмаз"),
    "Salyan": ("salyan", "сальян"),
    "Bərdə": ("berde", "barda", "барда"),
    "Astara": ("astara", "астара"),
    "Masallı": ("masalli", "масаллы"),
    "Ağdam": ("agdam", "агдам"),
    "Ağcabədi": ("agcabedi", "agjabadi", "агджабеди"),
    "Sabirabad": ("sabirabad", "сабирабад"),
    "Göyçay": ("goycay", "goychay", "геокчай"),
    "İmişli": ("imisli", "imishli", "имишли"),
    "Qazax": ("qazax", "gazakh", "казах"),
    "Tovuz": ("tovuz", "товуз"),
    "Şəmkir": ("semkir", "shamkir", "шамкир"),
    "Cəlilabad": ("celilabad", "jalilabad", "джалилабад"),
    "Kürdəmir": ("kurdemir", "kurdamir", "кюрдамир"),
    "Qusar": ("qusar", "gusar", "гусар"),
    "Beyləqan": ("beyleqan", "beylagan", "бейлаган"),
    "Füzuli": ("fuzuli", "физули"),
    "Tərtər": ("terter", "tartar", "тертер"),
    "Goranboy": ("goranboy", "геранбой"),
    "Şabran": ("sabran", "shabran", "шабран"),
    "Siyəzən": ("siyezen", "siyazan", "сиязань"),
    "Ucar": ("ucar", "ujar", "уджар"),
    "Balakən": ("balaken", "balakan", "балакен"),
    "Gədəbəy": ("gedebey", "gadabay", "гедабек"),
}
METRO = {"Bakı": "BAKU_METRO", "Xırdalan": "BAKU_METRO", "Sumqayıt": "BAKU_METRO"}

TABLES = {
    "make": MAKES,
    "fuel": FUELS,
    "transmission": TRANSMISSIONS,
    "drivetrain": DRIVETRAINS,
    "body": BODIES,
    "seller_type": SELLERS,
    "city": CITIES,
}


def spellings(table: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Folded spelling -> canonical member."""
    return {key: member for member, keys in table.items() for key in keys}


def as_map(found: dict, kind: str = "string") -> Column:
    """``found`` as one literal map: the JSON is read once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(found, ensure_ascii=False)), f"map<string,{kind}>")


def look_up(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    """The canonical member for a folded key, null where the table has none."""
    return F.try_element_at(as_map(spellings(table)), key)
