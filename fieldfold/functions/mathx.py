"""One set of formulas for Column expressions and for numpy arrays."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

#: Elementary functions over Columns: expressions that Catalyst compiles.
COLUMN = SimpleNamespace(
    sin=F.sin, cos=F.cos, tan=F.tan, asin=F.asin, atan2=F.atan2, sinh=F.sinh, cosh=F.cosh, atanh=F.atanh, sqrt=F.sqrt, hypot=F.hypot,
    radians=F.radians, degrees=F.degrees, floor=F.floor, mod=lambda a, b: F.pmod(a, F.lit(float(b))), number=lambda x: F.lit(float(x)),
    where=lambda c, a, b: F.when(c, a).otherwise(b),
)
#: The same over numpy arrays, for the simulator and the solvers.
NUMPY = SimpleNamespace(
    sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan2=np.arctan2, sinh=np.sinh, cosh=np.cosh, atanh=np.arctanh, sqrt=np.sqrt, hypot=np.hypot,
    radians=np.radians, degrees=np.degrees, floor=np.floor, mod=np.mod, number=float, where=np.where,
)
