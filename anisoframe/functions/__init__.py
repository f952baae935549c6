"""Column functions: scalars with IEEE rules, vectors, codecs, geometry, and the expression language over them."""
