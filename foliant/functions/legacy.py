"""Legacy Vietnamese code tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: TCVN3 characters as they look when read as Latin-1, and the letters meant. Fixed values.
TCVN3 = "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉË®ÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô­õøö÷ùúýûüþ¡¢§£¤¥¦"
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵĂÂĐÊÔƠƯ"
#: Characters that only TCVN3 has; the others are correct Vietnamese as well and tell nothing.
TCVN3_MARKERS = "".join(c for c in TCVN3 if c not in VIETNAMESE)


def tcvn3_repair(text: Column) -> Column:
    """``text`` in Unicode if it has a character that only TCVN3 uses, else as it is; null stays null."""
    return F.when(text.rlike(f"[{TCVN3_MARKERS}]"), F.translate(text, TCVN3, VIETNAMESE)).otherwise(text)
