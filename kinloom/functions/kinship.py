"""Kinship by shared centiMorgans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bands, both ends included, and the kinships that they allow.
BANDS = [
    (3300, 3720, "Pai/Mãe ↔ Filho(a)"),
    (2200, 3400, "Irmãos completos"),
    (1317, 2312, "Avós/Netos, Tios/Tias ↔ Sobrinhos(as), Meios-irmãos"),
    (553, 1330, "Primos de 1º grau"),
    (200, 850, "Primos de 1º grau (1× removido), Meios-primos, Tios-avós ↔ Sobrinhos-netos"),
    (46, 515, "Primos de 2º grau"),
    (30, 350, "Primos de 2º grau (1× removido), Primos de 3º grau"),
    (10, 220, "Primos de 3º grau (1× removido), Primos de 4º grau"),
    (0, 110, "Primos de 4º/5º grau ou mais distantes"),
]
UNKNOWN = "Relação distante ou indeterminada"


def relationships(cm: Column) -> Column:
    """The kinships whose bands hold the value, in the bands' order; none for null, NaN and values up to 0."""
    found = F.array_compact(F.array(*[F.when(cm.between(lo, hi), F.lit(name)) for lo, hi, name in BANDS]))
    some = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNKNOWN)))
    return F.when(cm.isNull() | F.isnan(cm) | (cm <= 0), F.array().cast("array<string>")).otherwise(some)
