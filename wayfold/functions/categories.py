"""Fixed category tables and the column functions that read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker priority of a facility code (1: any zoom, 2: from 0.8, 3: from 1.8).
MARKER_PRIORITY = {
    "F001": 1, "F002": 1, "F003": 1, "F004": 1, "F005": 1, "F006": 1, "F007": 1, "F008": 1, "F011": 3,
    "F012": 1, "F013": 2, "F014": 2, "F015": 2, "F017": 1, "F018": 1, "F020": 2, "F021": 2, "F027": 1,
    "F030": 2, "F031": 2, "F038": 1, "F039": 1, "F101": 2, "F102": 2, "F103": 2, "F106": 1, "F108": 1,
}
MARKER_MIN_ZOOM = {1: 0.0, 2: 0.8, 3: 1.8}
# Facility codes that become places: category, Japanese name, English name.
PLACE_CATEGORIES = {
    "F001": ("toilet", "トイレ（男性）", "Lavatory (Male)"),
    "F002": ("toilet", "トイレ（女性）", "Lavatory (Female)"),
    "F005": ("toilet", "多機能トイレ", "Multipurpose Lavatory"),
    "F011": ("stairs", "階段", "Stairs"),
    "F012": ("elevator", "エレベーター", "Elevator"),
    "F013": ("escalator", "エスカレーター", "Escalator"),
    "F014": ("slope", "スロープ", "Slope"),
    "F017": ("entrance", "施設出入口", "Entrance"),
    "F018": ("information", "受付・案内所", "Information"),
    "F020": ("waiting-room", "待合室", "Waiting Room"),
    "F021": ("nursing-room", "授乳室", "Nursing Room"),
    "F030": ("atm", "ATM", "ATM"),
    "F031": ("locker", "コインロッカー", "Coin Lockers"),
    "F101": ("ticket-office", "きっぷ売り場", "Ticket Office"),
    "F108": ("exit", "出口", "Exit"),
}


def looked_up(code: Column, values: dict) -> Column:
    """The code's value, or null."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[code]


def marker_priority(code: Column) -> Column:
    return looked_up(code, MARKER_PRIORITY)


def place_category(code: Column) -> Column:
    return looked_up(code, {c: v[0] for c, v in PLACE_CATEGORIES.items()})


# Codes of facilities that are no destinations, and why a destination without a place category makes no place.
NO_DESTINATIONS = ["F016", "F032", "F033", "F034", "F037", "F042", "F046", "F047", "F048", "F049", "F050", "F104"]
NOT_A_PLACE = "outside-current-named-place-taxonomy"


def promotion(code: Column) -> Column:
    """What becomes of a facility's code: destination, and either the category of its place or why it has none (excluded);
    both are null for codes that are no destinations."""
    known = code.isin([c for layer, c, *_ in CATEGORIES if layer == "Facility"])
    goal = F.coalesce(known & ~code.isin(NO_DESTINATIONS), F.lit(False))
    excluded = F.when(goal & place_category(code).isNull(), NOT_A_PLACE)
    return F.struct(goal.alias("destination"), F.when(goal, place_category(code)).alias("category"), excluded.alias("excluded"))


def name_ja(code: Column) -> Column:
    return looked_up(code, {c: v[1] for c, v in PLACE_CATEGORIES.items()})


def name_en(code: Column) -> Column:
    return looked_up(code, {c: v[2] for c, v in PLACE_CATEGORIES.items()})


# Category codes by map layer, with Japanese and English name, role, visual group and shape of drawing.
CATEGORIES = [
    ("Space", "B001", "商業施設", "Retail Store", "room", "retail", "surface"),
    ("Space", "B002", "事務所", "Office", "room", "office", "surface"),
    ("Space", "B003", "公的施設", "Public Facility", "room", "room", "surface"),
    ("Space", "B004", "待合室・休憩所", "Waiting Room", "room", "waiting", "surface"),
    ("Space", "B005", "きっぷ売り場", "Tickets", "service", "ticket", "surface"),
    ("Space", "B006", "受付・案内", "Information", "information", "information", "surface"),
    ("Space", "B007", "トイレ（男性用）", "Lavatory (Male)", "toilet", "toilet", "surface"),
    ("Space", "B008", "トイレ（女性用）", "Lavatory (Female)", "toilet", "toilet", "surface"),
    ("Space", "B009", "トイレ（男女共用）", "Lavatory (Unisex)", "toilet", "toilet", "surface"),
    ("Space", "B010", "トイレ（男女不明）", "Lavatory (Unspecified)", "toilet", "toilet", "surface"),
    ("Space", "B011", "多機能トイレ", "Multipurpose Lavatory", "multipurpose-toilet", "multipurpose-toilet", "surface"),
    ("Space", "B012", "多機能トイレ（オストメイト対応あり）", "Multipurpose Lavatory (Ostomate)", "multipurpose-toilet", "multipurpose-toilet", "surface"),
    ("Space", "B013", "多機能トイレ（おむつ交換シートあり）", "Multipurpose Lavatory (Change Diaper)", "multipurpose-toilet", "multipurpose-toilet", "surface"),
    ("Space", "B014", "多機能トイレ（オストメイト対応、おむつ交換シートあり）", "Multipurpose Lavatory (Ostomate, Change Diaper)", "multipurpose-toilet", "multipurpose-toilet", "surface"),
    ("Space", "B015", "喫煙場所", "Smoking Area", "amenity", "room", "surface"),
    ("Space", "B016", "授乳室", "Baby-feeding Room, Nursing Room", "amenity", "room", "surface"),
    ("Space", "B017", "病院・救護室", "First Aid", "safety", "room", "surface"),
    ("Space", "B018", "駅事務室", "Station Office", "service", "office", "surface"),
    ("Space", "B019", "その他部屋の範囲", "Other Room", "room", "room", "surface"),
    ("Space", "B020", "吹抜の範囲", "Open to Below", "structure", "barrier", "surface"),
    ("Space", "B021", "階段の範囲", "Stairs", "vertical-circulation", "stairs", "surface"),
    ("Space", "B022", "エレベーターの範囲", "Elevator", "vertical-circulation", "elevator", "surface"),
    ("Space", "B023", "エスカレーターの範囲", "Escalator", "vertical-circulation", "escalator", "surface"),
    ("Space", "B024", "動く歩道の範囲", "Moving Walkway", "circulation", "moving-walkway", "surface"),
    ("Space", "B025", "スロープの範囲", "Slope", "vertical-circulation", "slope", "surface"),
    ("Space", "B026", "非公開の範囲", "Non-Public", "restricted", "restricted", "surface"),
    ("Space", "B027", "駐車場", "Parking", "transport", "room", "surface"),
    ("Space", "B028", "プラットホーム", "Platform", "platform", "platform", "surface"),
    ("Space", "B029", "通路／コンコース", "Walkway", "circulation", "walkway", "surface"),
    ("Space", "B030", "ペデストリアンデッキ", "Pedestrian Deck", "circulation", "walkway", "surface"),
    ("Space", "B031", "歩道橋", "Pedestrian Overpass", "circulation", "walkway", "surface"),
    ("Space", "B999", "屋外", "Outside", "outdoor", "outdoor", "surface"),
    ("Fixture", "C001", "柱", "Column", "structure", "column", "solid"),
    ("Fixture", "C002", "ベンチ", "Bench", "furniture", "furniture", "low-solid"),
    ("Fixture", "C003", "受付・インフォメーションデスク", "Reception and Information Desks", "furniture", "furniture", "low-solid"),
    ("Fixture", "C004", "机・記帳台", "Cubicle", "furniture", "furniture", "low-solid"),
    ("Fixture", "C005", "ゴミ箱", "Rubbish Bin", "furniture", "furniture", "low-solid"),
    ("Fixture", "C006", "その他家具・什器", "Other Furniture / Fixtures", "furniture", "furniture", "low-solid"),
    ("Fixture", "C007", "小形簡易売店", "Kiosk", "service", "fixture", "solid"),
    ("Fixture", "C008", "障害物", "Obstruction", "barrier", "barrier", "solid"),
    ("Fixture", "C009", "植栽・花壇", "Vegetation", "barrier", "barrier", "low-solid"),
    ("Fixture", "C010", "パーテーション・間仕切壁", "Wall", "structure", "wall", "thin-barrier"),
    ("Fixture", "C011", "水部等", "Water", "barrier", "barrier", "low-solid"),
    ("Fixture", "C012", "ロッカー", "Locker Cabinet", "furniture", "furniture", "solid"),
    ("Fixture", "C013", "自動販売機", "Vending Machine", "furniture", "furniture", "solid"),
    ("Fixture", "C014", "ATM", "ATM", "service", "fixture", "solid"),
    ("Fixture", "C015", "ステージ", "Stage Platform", "barrier", "barrier", "low-solid"),
    ("Fixture", "C016", "柵", "Fence", "barrier", "barrier", "thin-barrier"),
    ("Fixture", "C101", "ホームドア・可動式ホーム柵等", "Platform Screen Doors, Platform Gates", "barrier", "barrier", "thin-barrier"),
    ("Fixture", "C102", "自動券売機", "Ticket Vending Machine", "service", "fixture", "solid"),
    ("Fixture", "C104", "自動改札機", "Automatic Ticket Gate", "barrier", "barrier", "low-solid"),
    ("Fixture", "C201", "ターンテーブル", "Baggage Carousel", "furniture", "furniture", "low-solid"),
    ("Fixture", "C202", "自動チェックイン機", "Passenger Ticketing / Automated Check-In Kiosk", "service", "fixture", "solid"),
    ("Fixture", "C999", "その他", "Uncategorized", "unknown", "unknown", "solid"),
    ("Facility", "F001", "トイレ（男性）", "Lavatory (Male)", "toilet", "toilet", "point-marker"),
    ("Facility", "F002", "トイレ（女性）", "Lavatory (Female)", "toilet", "toilet", "point-marker"),
    ("Facility", "F003", "トイレ（男女共用）", "Lavatory (Unisex)", "toilet", "toilet", "point-marker"),
    ("Facility", "F004", "トイレ（男女不明）", "Lavatory (Unspecified)", "toilet", "toilet", "point-marker"),
    ("Facility", "F005", "多機能トイレ", "Multipurpose Lavatory", "multipurpose-toilet", "multipurpose-toilet", "point-marker"),
    ("Facility", "F006", "多機能トイレ（オストメイト対応あり）", "Multipurpose Lavatory (Ostomate)", "multipurpose-toilet", "multipurpose-toilet", "point-marker"),
    ("Facility", "F007", "多機能トイレ（おむつ交換シートあり）", "Multipurpose Lavatory (Change Diaper)", "multipurpose-toilet", "multipurpose-toilet", "point-marker"),
    ("Facility", "F008", "多機能トイレ（オストメイト対応、おむつ交換シートあり）", "Multipurpose Lavatory (Ostomate, Change Diaper)", "multipurpose-toilet", "multipurpose-toilet", "point-marker"),
    ("Facility", "F009", "浴室", "Bathroom", "amenity", "poi", "point-marker"),
    ("Facility", "F010", "更衣室", "Changing Room", "amenity", "poi", "point-marker"),
    ("Facility", "F011", "階段", "Stairs", "vertical-circulation", "stairs", "point-marker"),
    ("Facility", "F012", "エレベーター", "Elevator", "vertical-circulation", "elevator", "point-marker"),
    ("Facility", "F013", "エスカレーター", "Escalator", "vertical-circulation", "escalator", "point-marker"),
    ("Facility", "F014", "スロープ", "Slope", "vertical-circulation", "slope", "point-marker"),
    ("Facility", "F015", "動く歩道", "Moving Walkway", "circulation", "moving-walkway", "point-marker"),
    ("Facility", "F016", "施設代表点", "Site", "landmark", "poi", "point-marker"),
    ("Facility", "F017", "施設出入口", "Entrance", "transport", "entrance", "point-marker"),
    ("Facility", "F018", "受付・案内所", "Information", "information", "poi", "point-marker"),
    ("Facility", "F019", "交番", "Police Box", "safety", "safety", "point-marker"),
    ("Facility", "F020", "待合室", "Waiting Room", "amenity", "poi", "point-marker"),
    ("Facility", "F021", "授乳室", "Nursing Room", "amenity", "poi", "point-marker"),
    ("Facility", "F022", "医療施設", "Medical", "safety", "safety", "point-marker"),
    ("Facility", "F023", "見学・展望施設", "Observation", "amenity", "poi", "point-marker"),
    ("Facility", "F024", "喫煙エリア", "Smoking Area", "amenity", "poi", "point-marker"),
    ("Facility", "F025", "店舗", "Store", "amenity", "poi", "point-marker"),
    ("Facility", "F026", "飲食コーナー", "Eating / Drinking", "amenity", "poi", "point-marker"),
    ("Facility", "F027", "AED", "AED", "safety", "safety", "point-marker"),
    ("Facility", "F028", "公衆電話", "Pay Phone", "amenity", "poi", "point-marker"),
    ("Facility", "F029", "郵便ポスト", "Post", "amenity", "poi", "point-marker"),
    ("Facility", "F030", "ATM", "ATM", "service", "poi", "point-marker"),
    ("Facility", "F031", "コインロッカー", "Coin Lockers", "amenity", "poi", "point-marker"),
    ("Facility", "F032", "自動販売機", "Vending Machine", "amenity", "poi", "point-marker"),
    ("Facility", "F033", "ベンチ", "Bench", "amenity", "poi", "point-marker"),
    ("Facility", "F034", "ゴミ箱", "Rubbish Bin", "amenity", "poi", "point-marker"),
    ("Facility", "F035", "階段昇降機／段差解消機", "Stairway Platform Lifts / Vertical Platform", "vertical-circulation", "elevator", "point-marker"),
    ("Facility", "F036", "充電ステーション", "Charging Stations", "amenity", "poi", "point-marker"),
    ("Facility", "F037", "案内サイン／案内板", "Guide Sign", "information", "poi", "point-marker"),
    ("Facility", "F038", "バス停留所", "Bus Stop", "transport", "poi", "point-marker"),
    ("Facility", "F039", "タクシー乗り場", "Taxi Stop", "transport", "poi", "point-marker"),
    ("Facility", "F040", "駐輪場", "Bicycle Parking Lot", "transport", "poi", "point-marker"),
    ("Facility", "F041", "駐車場", "Parking", "transport", "poi", "point-marker"),
    ("Facility", "F042", "地図表記用注記", "Notes for Map Representation", "information", "poi", "point-marker"),
    ("Facility", "F043", "ランドマーク", "Landmark", "landmark", "poi", "point-marker"),
    ("Facility", "F044", "展示物", "Exhibit", "landmark", "poi", "point-marker"),
    ("Facility", "F045", "公衆無線LAN", "Public Wi-Fi", "amenity", "poi", "point-marker"),
    ("Facility", "F046", "消火器", "Fire Extinguisher", "safety", "safety", "point-marker"),
    ("Facility", "F047", "消火栓", "Fire Hydrant", "safety", "safety", "point-marker"),
    ("Facility", "F048", "火災報知器", "Fire Alarm", "safety", "safety", "point-marker"),
    ("Facility", "F049", "非常誘導灯", "Emergency Guide Light", "safety", "safety", "point-marker"),
    ("Facility", "F050", "音による案内設備", "Sound Guidance Facility", "information", "poi", "point-marker"),
    ("Facility", "F101", "きっぷ売り場", "Ticket Office", "service", "poi", "point-marker"),
    ("Facility", "F102", "定期券売り場", "Commuter Ticket Office", "service", "poi", "point-marker"),
    ("Facility", "F103", "精算所", "Fare Adjustment", "service", "poi", "point-marker"),
    ("Facility", "F104", "駅事務室", "Station Staffroom", "service", "poi", "point-marker"),
    ("Facility", "F105", "忘れもの預かり所", "Lost and Found", "service", "poi", "point-marker"),
    ("Facility", "F106", "改札口", "Ticket Gate", "transport", "poi", "point-marker"),
    ("Facility", "F107", "売店／キオスク", "Kiosk", "amenity", "poi", "point-marker"),
    ("Facility", "F108", "出口", "Exit", "transport", "exit", "point-marker"),
    ("Facility", "F109", "インターホン", "Interphone", "safety", "safety", "point-marker"),
]
# Names of a code that no table has.
UNKNOWN = ("不明なカテゴリー", "Unknown category")
# Fixtures that are drawn in a way of their own.
FIXTURE_GROUPS = {"C002": "bench", "C012": "locker", "C013": "vending-machine", "C014": "atm", "C101": "platform-gate", "C104": "ticket-gate"}
COLUMNS = ["layer", "code", "name_ja", "name_en", "role", "group", "shape"]


def category_rows() -> list[tuple]:
    """One tuple of COLUMNS for each known code."""
    return list(CATEGORIES)
