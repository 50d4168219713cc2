"""The rule set and the categories: re-authored from the public OpenStreetMap tagging scheme, as families of rules.

A building's code is `building_` and its tag's value unless given otherwise; other codes name one tag each.
"""

from __future__ import annotations

from geoloom.operators.rules import ANY, Rule

# Fixed values: (building value, English, Turkish, name parts). Buildings without name parts are sure by their tag alone.
_BUILDINGS = [
    ("residential", "Residential", "Konut - Genel", []),
    ("house", "House", "Müstakil Ev", []),
    ("apartments", "Apartments", "Apartman", []),
    ("detached", "Detached House", "Villa", []),
    ("terrace", "Terrace", "İkiz / Sıra Ev", []),
    ("commercial", "Commercial", "Ticari Genel", []),
    ("office", "Office Building", "Ofis Binası", []),
    ("retail", "Retail Building", "Alışveriş Merkezi", []),
    ("industrial", "Industrial", "Endüstriyel", []),
    ("warehouse", "Warehouse", "Depo", []),
    ("hospital", "Hospital Building", "Hastane Binası", ["hastane"]),
    ("school", "School Building", "Okul Binası", ["okul", "ilkokul", "ortaokul", "lise"]),
    ("university", "University Building", "Üniversite Binası", ["üniversite", "fakülte"]),
    ("public", "Public Building", "Kamu Binası", []),
    ("civic", "Civic Building", "Belediye", ["belediye"]),
    ("police", "Police Building", "Karakol", ["karakol"]),
    ("fire_station", "Fire Station", "İtfaiye", ["itfaiye"]),
    ("garages", "Garage / Parking", "Garaj / Otopark", []),
    ("sports_hall", "Sports Hall", "Spor Salonu", ["spor salonu"]),
    ("historic", "Historic Building", "Tarihsel", []),
]

# Fixed values: (building value, religion, English, Turkish, name parts).
_WORSHIP = [("mosque", "muslim", "Mosque", "Cami", ["cami", "mescit"]), ("church", "christian", "Church", "Kilise", ["kilise"]), ("synagogue", "jewish", "Synagogue", "Sinagog", ["sinagog", "havra"])]

# Group -> (code, key, tag, other forms, English, Turkish, name parts).
_POINTS = {
    "health": [
        ("hospital", "hospital", "amenity=hospital", ["healthcare=hospital"], "Hospital", "Hastane", ["hastane"]),
        ("clinic", "clinic", "amenity=clinic", ["healthcare=clinic"], "Clinic", "Klinik / Poliklinik", ["klinik", "poliklinik", "tıp merkezi"]),
        ("family_health", "family_health", "amenity=doctors", ["healthcare=doctor"], "Family Health Center", "Aile Hekimi / Sağlık Ocağı", ["aile sağlığı", "sağlık ocağı"]),
        ("dentist", "dentist", "amenity=dentist", ["healthcare=dentist"], "Dentist", "Diş Hekimi", ["diş hekimi", "diş kliniği"]),
        ("pharmacy", "pharmacy", "amenity=pharmacy", ["healthcare=pharmacy"], "Pharmacy", "Eczane", ["eczane"]),
        ("emergency", "emergency", "emergency=yes", [], "Emergency", "Acil Servis", ["acil servis"]),
        ("veterinary", "veterinary", "amenity=veterinary", [], "Veterinary", "Veteriner", ["veteriner"]),
        ("ambulance_station", "ambulance_station", "emergency=ambulance_station", [], "Ambulance Station", "Ambulans İstasyonu", ["ambulans"]),
        ("optician", "optician", "shop=optician", [], "Optician", "Optisyen", ["optik"]),
        ("private_hospital", "private_hospital", "amenity=hospital&operator:type=private", [], "Private Hospital", "Hastane - Özel", ["özel hastane"]),
        ("public_hospital", "public_hospital", "amenity=hospital&operator:type=public", [], "Public Hospital", "Hastane - Kamu", ["devlet hastanesi"]),
    ],
    "education": [
        ("primary_school", "primary_school", "amenity=school&isced:level=1", [], "Primary School", "İlkokul", ["ilkokul"]),
        ("middle_school", "middle_school", "amenity=school&isced:level=2", [], "Middle School", "Ortaokul", ["ortaokul"]),
        ("high_school", "high_school", "amenity=school&isced:level=3", [], "High School", "Lise", ["lise"]),
        ("public_school", "public_school", "amenity=school&operator:type=public", [], "Public School", "Devlet Okulu", ["anadolu"]),
        ("private_school", "private_school", "amenity=school&operator:type=private", [], "Private School", "Özel Okul", ["kolej"]),
        ("education_university", "university", "amenity=university", ["amenity=college"], "University", "Üniversite", ["üniversite", "fakülte"]),
        ("student_dormitory", "student_dormitory", "building=dormitory", ["amenity=student_accommodation"], "Student Dormitory", "Yurt / KYK", ["öğrenci yurdu"]),
        ("kindergarten", "kindergarten", "amenity=kindergarten", [], "Kindergarten", "Anaokulu / Kreş", ["anaokul", "kreş"]),
        ("college_course", "college_course", "amenity=prep_school", ["office=educational_institution"], "College / Course", "Dershane / Kurs", ["dershane", "kurs"]),
        ("library", "library", "amenity=library", [], "Library", "Kütüphane", ["kütüphane"]),
    ],
    "green_area": [
        ("park", "park", "leisure=park", [], "Park", "Park", ["park"]),
        ("playground", "playground", "leisure=playground", [], "Playground", "Çocuk Oyun Alanı", ["oyun alanı"]),
        ("pitch", "pitch", "leisure=pitch", [], "Pitch", "Spor Sahası", ["halı saha", "futbol sahası"]),
        ("garden", "garden", "leisure=garden", [], "Botanical Garden", "Botanik Bahçe", ["botanik"]),
        ("forest", "forest", "landuse=forest", ["natural=wood"], "Forest", "Orman / Koruluk", ["orman", "koru"]),
        ("cemetery", "cemetery", "landuse=cemetery", ["amenity=grave_yard"], "Cemetery", "Mezarlık", ["mezarlık"]),
        ("beach", "beach", "natural=beach", ["leisure=beach_resort"], "Beach", "Sahil / Kıyı Bandı", ["plaj", "sahil"]),
        ("sports_centre", "sports_centre", "leisure=sports_centre", [], "Sports Centre", "Spor Kompleksi", ["spor kompleksi"]),
        ("stadium", "stadium", "leisure=stadium", [], "Stadium", "Stadyum", ["stadyum"]),
    ],
    "transport": [
        ("bus_stop", "bus_stop", "highway=bus_stop", [], "Bus Stop", "Otobüs Durağı", ["otobüs durağı"]),
        ("metro_station", "metro_station", "railway=station&station=subway", [], "Metro Station", "Metro İstasyonu", ["metro istasyonu"]),
        ("metrobus_stop", "metrobus_stop", "highway=bus_stop&network=metrobus", [], "Metrobus Stop", "Metrobüs Durağı", ["metrobüs"]),
        ("tram_stop", "tram_stop", "railway=tram_stop", [], "Tram Stop", "Tramvay Durağı", ["tramvay"]),
        ("ferry_terminal", "ferry_terminal", "amenity=ferry_terminal", [], "Ferry Terminal", "Vapur İskelesi", ["iskele"]),
        ("bus_station", "bus_station", "amenity=bus_station", [], "Bus Station", "Otogar", ["otogar"]),
        ("parking", "parking", "amenity=parking", [], "Parking", "Otopark", ["otopark"]),
        ("bicycle_parking", "bicycle_parking", "amenity=bicycle_parking", [], "Bicycle Parking", "Bisiklet Park", []),
        ("taxi", "taxi", "amenity=taxi", [], "Taxi", "Taksi Durağı", ["taksi"]),
        ("bridge", "bridge", "bridge=yes", ["man_made=bridge"], "Bridge", "Köprü", ["köprü"]),
    ],
    "commerce": [
        ("supermarket", "supermarket", "shop=supermarket", [], "Supermarket", "Süpermarket", ["süpermarket"]),
        ("market", "market", "shop=convenience", [], "Convenience Store", "Market", ["market", "bakkal"]),
        ("mall", "mall", "shop=mall", [], "Mall", "AVM", ["avm", "alışveriş merkezi"]),
        ("bank", "bank", "amenity=bank", [], "Bank", "Banka", ["bankası"]),
        ("atm", "atm", "amenity=atm", [], "ATM", "ATM", ["atm"]),
        ("restaurant", "restaurant", "amenity=restaurant", [], "Restaurant", "Restoran", ["restoran", "lokanta"]),
        ("cafe", "cafe", "amenity=cafe", [], "Cafe", "Kafe", ["kafe", "cafe"]),
        ("post_office", "post_office", "amenity=post_office", [], "Post Office", "Postane", ["postane", "ptt"]),
        ("commerce_hotel", "hotel", "tourism=hotel", ["building=hotel"], "Hotel", "Otel", ["otel", "hotel"]),
        ("fuel", "fuel", "amenity=fuel", [], "Fuel Station", "Benzin İstasyonu", ["akaryakıt", "benzin"]),
    ],
    "infrastructure": [
        ("power_substation", "power_substation", "power=substation", [], "Power Substation", "Elektrik Trafosu", ["trafo"]),
        ("water_tower", "water_tower", "man_made=water_tower", ["man_made=storage_tank"], "Water Tower", "Su Deposu", ["su deposu"]),
        ("communication_tower", "communication_tower", "man_made=communications_tower", ["man_made=tower"], "Communication Tower", "İletişim Kulesi", []),
        ("waste_disposal", "waste_disposal", "amenity=waste_disposal", [], "Waste Disposal", "Çöp Toplama", []),
        ("recycling", "recycling", "amenity=recycling", [], "Recycling", "Geri Dönüşüm", ["geri dönüşüm"]),
        ("infrastructure_police", "police", "amenity=police", [], "Police", "Karakol", ["karakol"]),
        ("infrastructure_fire_station", "fire_station", "amenity=fire_station", [], "Fire Station", "İtfaiye İstasyonu", ["itfaiye"]),
        ("power_line", "power_line", "power=line", [], "Power Line", "Elektrik Hattı", []),
        ("mast", "mast", "man_made=mast", [], "Base Station", "Baz İstasyonu", []),
    ],
    "culture": [
        ("museum", "museum", "tourism=museum", [], "Museum", "Müze", ["müze"]),
        ("historic_building", "historic_building", "historic=building", ["historic=yes"], "Historic Building", "Tarihi Yapı", []),
        ("monument", "monument", "historic=monument", ["historic=memorial"], "Monument", "Anıt", ["anıt"]),
        ("castle", "castle", "historic=castle", ["historic=city_gate", "historic=citywalls"], "Castle / Walls", "Kale / Sur", ["kalesi"]),
        ("theatre", "theatre", "amenity=theatre", [], "Theatre", "Tiyatro", ["tiyatro"]),
        ("cinema", "cinema", "amenity=cinema", [], "Cinema", "Sinema", ["sinema"]),
        ("arts_centre", "arts_centre", "amenity=arts_centre", [], "Arts Centre", "Kültür Merkezi", ["kültür merkezi"]),
        ("public_bath", "public_bath", "amenity=public_bath", [], "Public Bath", "Hamam", ["hamam"]),
    ],
}

# Groups in the order of the user interface.
GROUPS = [("admin_boundaries", "Administrative Boundaries", "İdari Sınırlar"), ("buildings", "Buildings", "Binalar"), ("health", "Health", "Sağlık"), ("education", "Education", "Eğitim"), ("green_area", "Green Area", "Yeşil Alan"), ("transport", "Transport", "Ulaşım"), ("commerce", "Commerce", "Ticaret"), ("infrastructure", "Infrastructure", "Altyapı"), ("culture", "Culture", "Kültür")]
#: Rules whose name parts cover those of sharper ones.
UMBRELLAS = ["building_school", "building_religious", "public_school"]
RELIGION = {f"building_{value}": religion for value, religion, *_ in _WORSHIP}
_FAMILIES = {"green_area": "landuse", "transport": "transport", "infrastructure": "infrastructure", "culture": "culture"}
_HOMES = ["apartments", "house", "detached", "terrace"]


def _tags(text: str) -> dict[str, str]:
    return dict(x.split("=", 1) for x in text.split("&"))


def build_rules() -> list[Rule]:
    """All rules in registry order."""
    out = []
    for value, english, turkish, names in _BUILDINGS:
        query = [{"building": value}]
        support = {}
        if value == "residential":
            query += [{"building": x} for x in _HOMES]
        elif value == "apartments":
            query.append({"building": "residential"})
        elif names:
            query.append({"amenity": value})
            support = {"amenity": {"civic": "townhall"}.get(value, value)}
        out.append(Rule(f"building_{value}", "buildings", value, english, turkish, query, [{"building": value}], support, names, bool(names), bool(names), family="building", geometry=("Polygon",)))
    out.append(Rule("building_religious", "buildings", "religious", "Religious Building", "Dini Yapı - Genel", [{"amenity": "place_of_worship"}], [{"building": "religious"}, {"amenity": "place_of_worship"}], {"religion": ANY}, [], family="building"))
    for value, religion, english, turkish, names in _WORSHIP:
        strict = [{"building": value}, {"amenity": "place_of_worship", "religion": religion}]
        out.append(Rule(f"building_{value}", "buildings", value, english, turkish, strict, strict, {"religion": religion}, names, True, True, family="building"))
    for group, members in _POINTS.items():
        for code, key, tag, forms, english, turkish, names in members:
            query = [_tags(x) for x in (tag, *forms)]
            support = query[1] if len(query) > 1 and len(query[1]) == 1 else {}
            out.append(Rule(code, group, key, english, turkish, query, [_tags(tag)], support, names, bool(names), bool(names) and group != "green_area", family=_FAMILIES.get(group, "poi")))
    points = [{"emergency": "assembly_point"}, {"amenity": "assembly_point"}, {"amenity": "emergency_assembly_point"}]
    out.append(Rule("assembly_point", "green_area", "assembly_point", "Assembly Point", "Toplanma Alanı", [*points, {"leisure": "park"}], points, {}, ["toplanma alanı"], False, False, query_score=1, family="landuse"))
    for level, key in ((8, "neighbourhood"), (6, "district"), (4, "province")):
        out.append(Rule(f"admin_{key}", "admin_boundaries", key, f"{key.title()} Boundaries", "", [{"boundary": "administrative", "admin_level": str(level)}], [{"boundary": "administrative", "admin_level": str(level)}], family="admin", geometry=("Polygon",)))
    return out


RULES = build_rules()
BY_CODE = {r.code: r for r in RULES}
#: Codes that exist as categories without a rule of their own.
DERIVED = [("building_yes", "buildings", "yes", "Unspecified Building (yes)", "Belirsiz Bina (yes)"), ("building_yes_unresolved", "buildings", "yes_unresolved", "Unresolved yes Buildings", "Çözülemeyen yes Binaları")]


def categories(spark):
    """(code, cat_key, sub_key, label_en, label_tr, ui_order)."""
    order = {g: k for k, (g, *_) in enumerate(GROUPS, 1)}
    rows = [(r.code, r.group, r.key, r.label_en, r.label_tr, order.get(r.group, 999)) for r in RULES] + [(c, g, k, e, t, order[g]) for c, g, k, e, t in DERIVED]
    return spark.createDataFrame(rows, "code string, cat_key string, sub_key string, label_en string, label_tr string, ui_order int")


def code_of(category: str, subcategory: str) -> str | None:
    return next((r.code for r in RULES if (r.group, r.key) == (category, subcategory)), None)


def rules_of_group(group: str) -> list[Rule]:
    return [r for r in RULES if r.group == group]


def name_patterns() -> list[tuple[str, str]]:
    """(name part, code) as written."""
    return [(p, r.code) for r in RULES for p in r.patterns]
