"""Texts for people in two languages: floors, places, areas, steps, warnings, estimates. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Templates by language; {name} is replaced.
MESSAGES = {
    "en": {
        "floor.ground": "Ground",
        "floor.ground-long": "Ground floor",
        "floor": "Floor {floor}",
        "time.there": "Already there",
        "time.minutes": "About {minutes} min",
        "place.access": "{area} · {distance} m access",
        "access": "From {place}, continue {distance} to the pedestrian network on {floor}.",
        "transition": "Take the {movement} from {fromFloor} to {toFloor} for {distance}.",
        "continue": "Continue on {floor} for {distance}.",
        "turn-left": "Turn left and continue on {floor} for {distance}.",
        "turn-right": "Turn right and continue on {floor} for {distance}.",
        "arrive-access": "Leave the network and continue {distance} to {place}.",
        "arrive": "Arrive at {place}.",
        "already-there": "You are already at {place}.",
        "warning.fields": "Accessibility data is incomplete for: {fields}. Unknown segments are allowed by policy.",
        "warning.access": "Wheelchair accessibility has not been verified for the direct place-to-network access at: {places}.",
        "changes.one": "1 floor change",
        "changes.many": "{count} floor changes",
        "warnings.none": "No route warnings.",
        "warnings.one": "1 route warning.",
        "warnings.many": "{count} route warnings.",
    },
    "ja": {
        "floor.ground": "地上階",
        "floor.ground-long": "地上階",
        "floor": "{floor}階",
        "time.there": "到着済み",
        "time.minutes": "約{minutes}分",
        "place.access": "{area}・アクセス {distance} m",
        "access": "{place}から{floor}の歩行者ネットワークまで{distance}進みます。",
        "transition": "{movement}で{fromFloor}から{toFloor}へ移動します（{distance}）。",
        "continue": "{floor}を{distance}進みます。",
        "turn-left": "左に曲がり、{floor}を{distance}進みます。",
        "turn-right": "右に曲がり、{floor}を{distance}進みます。",
        "arrive-access": "歩行者ネットワークを離れ、{place}まで{distance}進みます。",
        "arrive": "{place}に到着です。",
        "already-there": "すでに{place}に到着しています。",
        "warning.fields": "アクセシビリティ情報が不完全です：{fields}。情報が不明な区間は現在の方針により利用可能として扱います。",
        "warning.access": "次の場所から歩行者ネットワークまでの車いす対応状況は未確認です：{places}。",
        "changes.one": "階の移動 1回",
        "changes.many": "階の移動 {count}回",
        "warnings.none": "経路に関する注意事項はありません。",
        "warnings.one": "経路に関する注意事項が1件あります。",
        "warnings.many": "経路に関する注意事項が{count}件あります。",
    },
}
# Place categories, movements and profiles by language.
CATEGORY_NAMES = {
    "en": {"gate": "Gate", "connector": "Floor connector", "toilet": "Toilet", "elevator": "Elevator", "escalator": "Escalator", "stairs": "Stairs", "slope": "Slope", "entrance": "Entrance", "exit": "Exit", "information": "Information", "waiting-room": "Waiting room", "nursing-room": "Nursing room", "atm": "ATM", "locker": "Coin lockers", "ticket-office": "Ticket office"},
    "ja": {"gate": "改札", "connector": "階接続", "toilet": "トイレ", "elevator": "エレベーター", "escalator": "エスカレーター", "stairs": "階段", "slope": "スロープ", "entrance": "入口", "exit": "出口", "information": "案内", "waiting-room": "待合室", "nursing-room": "授乳室", "atm": "ATM", "locker": "コインロッカー", "ticket-office": "きっぷ売り場"},
}
MOVEMENT_NAMES = {
    "en": {"stairs": "stairs", "escalator": "escalator", "elevator": "elevator", None: "passage"},
    "ja": {"stairs": "階段", "escalator": "エスカレーター", "elevator": "エレベーター", None: "通路"},
}
PROFILE_NAMES = {
    "en": {"shortest": "Shortest", "accessible": "Wheelchair accessible", "avoid-stairs": "Avoid stairs", "prefer-elevator": "Prefer elevators", "fewest-floor-changes": "Fewest floor changes"},
    "ja": {"shortest": "最短", "accessible": "車いす対応", "avoid-stairs": "階段を避ける", "prefer-elevator": "エレベーター優先", "fewest-floor-changes": "階の移動を最小化"},
}
# Fixed pattern: names that only make sense to a system.
TECHNICAL_NAME = r"^(?:[A-Z]{2,}[A-Z0-9]*[_-]|[A-Z]+_[A-Z0-9_-]+$)"


def message(locale: str, key: str, **values: Column) -> Column:
    out = F.lit(MESSAGES[locale][key])
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def _named(names: dict, key: Column) -> Column:
    """The key's name, or the one that stands for all others."""
    out = F.lit(names.get(None))
    for k, v in names.items():
        if k is not None:
            out = F.when(key == k, v).otherwise(out)
    return out


def category_name(category: Column, locale: str) -> Column:
    return _named(CATEGORY_NAMES[locale], category)


def movement_name(kind: Column, locale: str) -> Column:
    return _named(MOVEMENT_NAMES[locale], kind)


def profile_name(profile: Column, locale: str) -> Column:
    return _named(PROFILE_NAMES[locale], profile)


def floor_name(floor: Column, locale: str) -> Column:
    out = floor
    if locale == "ja":
        deep = F.regexp_extract(floor, r"^B(\d+)$", 1)
        out = F.when(deep != "", F.concat(F.lit("地下"), deep, F.lit("階"))).when(floor.rlike(r"^\d+$"), message(locale, "floor", floor=floor)).otherwise(floor)
    return F.when(floor == "0", message(locale, "floor.ground")).otherwise(out)


def floor_long_name(floor: Column, locale: str) -> Column:
    rest = floor_name(floor, locale) if locale == "ja" else message(locale, "floor", floor=floor)
    return F.when(floor == "0", message(locale, "floor.ground-long")).otherwise(rest)


def one_decimal(x: Column) -> Column:
    """A size with one decimal, ties upward; only quarters are ties in binary."""
    return F.call_function("format_number", F.when(F.pmod(x, F.lit(1.0)) == 0.25, x + 0.04).otherwise(x), F.lit("0.0"))


def distance(m: Column) -> Column:
    whole = F.floor(m + 0.5).cast("long").cast("string")
    return F.concat(F.when(m < 10, one_decimal(m)).otherwise(whole), F.lit(" m"))


def estimate(minutes: Column, locale: str) -> Column:
    return F.when(minutes == 0, message(locale, "time.there")).otherwise(message(locale, "time.minutes", minutes=minutes))


def floor_changes(n: Column, locale: str) -> Column:
    return F.when(n == 1, message(locale, "changes.one")).otherwise(message(locale, "changes.many", count=n))


def warning_count(n: Column, locale: str) -> Column:
    return F.when(n == 0, message(locale, "warnings.none")).when(n == 1, message(locale, "warnings.one")).otherwise(message(locale, "warnings.many", count=n))


def translated(ja: Column, en: Column, fallback: Column, locale: str) -> Column:
    """A translation's text (Japanese where English is pending), or the fallback where there is none."""
    return F.coalesce(en, ja, fallback) if locale == "en" else F.coalesce(ja, fallback)


def place_name(name: Column, name_kind: Column, category: Column, floor: Column, ja: Column, en: Column, locale: str) -> Column:
    """What a place is called in public; generated and technical names give way to category and floor."""
    odd = F.coalesce(name_kind == "generated-descriptive", F.lit(False)) | name.rlike(TECHNICAL_NAME)
    plain = F.when(odd, F.concat(category_name(category, locale), F.lit(" · "), floor_name(floor, locale))).otherwise(name)
    return translated(ja, en, plain, locale)


def place_access(area: Column, m: Column, locale: str) -> Column:
    return message(locale, "place.access", area=area, distance=one_decimal(m))


def clean_area(name: Column) -> Column:
    """An area's name without the number that orders it, parts set apart by middle dots."""
    return F.replace(F.regexp_replace(name, r"^\d+\.", ""), F.lit("_"), F.lit("・"))


def instruction(locale: str, start: Column, destination: Column, there: Column | None = None) -> Column:
    """The text of a step (columns kind, distance_m, floor_from, floor_to, movement); there: start is destination."""
    m, kind = distance(F.col("distance_m")), F.col("kind")
    here = floor_name(F.col("floor_from"), locale)
    out = F.when(kind == "access", message(locale, "access", place=start, distance=m, floor=here))
    change = dict(movement=movement_name(F.col("movement"), locale), fromFloor=here, toFloor=floor_name(F.col("floor_to"), locale), distance=m)
    out = out.when(kind == "transition", message(locale, "transition", **change))
    for k in ("turn-left", "turn-right", "continue"):
        out = out.when(kind == k, message(locale, k, floor=here, distance=m))
    if there is not None:
        out = out.when(there, message(locale, "already-there", place=destination))
    return out.when(F.col("distance_m") > 0, message(locale, "arrive-access", place=destination, distance=m)).otherwise(message(locale, "arrive", place=destination))


def unknown_fields(fields: Column, locale: str) -> Column:
    return message(locale, "warning.fields", fields=F.array_join(fields, ", "))


def unverified_access(names: Column, locale: str) -> Column:
    return message(locale, "warning.access", places=F.array_join(names, "、" if locale == "ja" else ", "))
