"""Synthetic Chinese names and id cards that follow from a value and a seed, and seeds of sessions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrimlake.functions import text as T
from scrimlake.functions.values import ID_CHECK, ID_WEIGHTS

# fixed values: surnames of one sign, of two, and the first signs of given names that men, women and anybody have; pattern of an id card of 18 or 15 signs
ONE_SIGN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎"
TWO_SIGNS = (
    "欧阳", "太史", "端木", "上官", "司马", "东方", "独孤", "南宫", "万俟", "闻人", "夏侯", "诸葛", "尉迟", "公羊", "赫连", "澹台", "皇甫", "宗政",
    "濮阳", "公淳", "单于", "太叔", "申屠", "公孙", "仲孙", "轩辕", "令狐", "钟离", "宇文", "长孙", "慕容", "鲜于", "闾丘", "司徒", "司空",
)
MEN = "伟强磊洋勇军杰涛超明刚平辉鹏华飞鑫波斌宇建建国志卫勇国文浩然博文宇昊天铭轩睿"
WOMEN = "静丽娟燕艳梅玲芳娜敏洁红霞萍玲婷雪慧颖琳玉桂秀淑海丽秀晓欣怡梦瑶萱菲琪妍薇倩"
ANYBODY = "子小晓思嘉雨新一之文云月星天可安宁欣然如"
ID_18 = r"^[1-9][0-9]{5}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]$"
ID_15 = r"^[1-9][0-9]{5}[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}$"


def session_seed(session: Column, seed: int | None = None) -> Column:
    """The seed of a session's values, so that a value has another one in another session."""
    own = F.conv(F.left(F.sha2(session.cast("string"), 256), F.lit(8)), 16, 10).cast("long")
    return own if seed is None else (own + seed) % (1 << 31)


def _keyed(seed: Column, text: Column) -> Column:
    return F.concat(seed.cast("string"), F.lit(":"), text)


def _low(text: Column) -> Column:
    """The md5 of a text modulo 2 ** 32."""
    return F.conv(F.substring(F.md5(text), 25, 8), 16, 10).cast("long")


def _sign(signs: str, at: Column) -> Column:
    return F.substr(F.lit(signs), at.cast("int") + 1, F.lit(1))


def synthetic_name(name: Column, seed: Column, gender: str | None = None) -> Column:
    """Another name with a surname and a given name of as many signs; names of fewer than two stay. gender: male or female, for the second of two given signs."""
    held = F.trim(name)
    compound = F.left(held, F.lit(2)).isin(*TWO_SIGNS)
    surname = F.when(compound, F.left(held, F.lit(2))).otherwise(F.left(held, F.lit(1)))
    given = F.when(compound, F.substr(held, F.lit(3))).otherwise(F.substr(held, F.lit(2)))
    of = _keyed(seed, surname)
    new = F.when(compound, F.element_at(F.array(*[F.lit(x) for x in TWO_SIGNS]), T.md5_mod(of, len(TWO_SIGNS)).cast("int") + 1)).otherwise(_sign(ONE_SIGN, T.md5_mod(of, len(ONE_SIGN))))
    every = MEN + WOMEN + 2 * ANYBODY
    second = {"male": MEN + ANYBODY, "female": WOMEN + ANYBODY}.get(gender, every)
    key = _keyed(seed, F.concat(name, given))
    first, low = T.md5_mod(key, len(every)), _low(key)
    other = (low * 31 + 17) % (1 << 32)
    pick = lambda h: _sign(second, h % len(second))
    two = F.when(_sign(every, first) == pick(other), pick((other + 1) % (1 << 32))).otherwise(pick(other))
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(given), F.lit(1)) - 1), lambda i: _sign(every, (low + i * 31) % (1 << 32) % len(every))), "")
    made = F.when(F.length(given) == 0, "").when(F.length(given) == 1, _sign(every, first)).when(F.length(given) == 2, F.concat(_sign(every, first), two)).otherwise(more)
    return F.when(F.length(name) < 2, name).otherwise(F.concat(new, made))


def check_digit(seventeen: Column) -> Column:
    total = sum((F.substring(seventeen, k, 1).cast("int") * w for k, w in enumerate(ID_WEIGHTS[1:], 2)), F.substring(seventeen, 1, 1).cast("int") * ID_WEIGHTS[0])
    return _sign(ID_CHECK, total % 11)


def synthetic_id_card(card: Column, seed: Column) -> Column:
    """An id card of the same province, date of birth and gender with a check digit that holds; a card of 15 signs gets 18. What is no card stays."""
    held = F.upper(F.trim(card))
    long, short = held.rlike(ID_18), held.rlike(ID_15)
    region = F.left(held, F.lit(6))
    born = F.when(long, F.substring(held, 7, 8)).otherwise(F.concat(F.lit("19"), F.substring(held, 7, 6)))
    number = F.when(long, F.substring(held, 17, 1)).otherwise(F.substring(held, 15, 1)).cast("int")
    key = _keyed(seed, F.concat(card, F.lit("seq")))
    last = F.floor(T.md5_mod(key, 1280) / 256) * 2 + number % 2
    place = F.lpad(T.md5_mod(_keyed(seed, region), 10_000).cast("string"), 4, "0")
    made = F.concat(F.left(held, F.lit(2)), place, born, F.lpad(T.md5_mod(key, 100).cast("string"), 2, "0"), last.cast("string"))
    return F.when(long | short, F.concat(made, check_digit(made))).otherwise(card)
