"""Twelve units' predictors and responses of the elastic-net examples."""

ELASTIC_X = [
    [0.0, 1.0, 0.0, 0.08333333333333333],
    [0.0, 2.0, 0.0, 0.16666666666666666],
    [0.0, 3.0, 0.0, 0.25],
    [0.0, 1.0, 0.0, 0.3333333333333333],
    [0.0, 2.0, 0.0, 0.4166666666666667],
    [0.0, 3.0, 0.0, 0.5],
    [1.0, 1.0, 1.0, 0.5833333333333334],
    [1.0, 2.0, 2.0, 0.6666666666666666],
    [1.0, 3.0, 3.0, 0.75],
    [1.0, 1.0, 1.0, 0.8333333333333334],
    [1.0, 2.0, 2.0, 0.9166666666666666],
    [1.0, 3.0, 3.0, 1.0],
]

ELASTIC_Y = [
    [-0.12841495341570858, 0.28888237554329987, -0.14090077960413011],
    [-0.20332991054623833, 0.13905246128224036, 0.11751759659867345],
    [-0.12841495341570858, -0.1193659149205632, 0.26734751085973296],
    [-0.12841495341570858, 0.28888237554329987, -0.14090077960413011],
    [0.040687025310054192, 0.049736063805199571, 0.028201199121632659],
    [0.13000342278709498, -0.19428087205109296, 0.11751759659867345],
    [-0.12841495341570858, -0.1193659149205632, 0.26734751085973296],
    [0.13000342278709498, -0.19428087205109296, 0.11751759659867345],
    [0.46333675612042835, -0.52761420538442627, -0.54914906007799318],
    [-0.12841495341570858, 0.28888237554329987, -0.14090077960413011],
    [0.040687025310054192, 0.049736063805199571, 0.028201199121632659],
    [0.040687025310054192, 0.049736063805199571, 0.028201199121632659],
]
