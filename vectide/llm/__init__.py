"""Training-data operators: ten corpus-scale components, each in a module of its own.

Nothing else in the package imports this subpackage; ``registry`` lists its queries.
"""
