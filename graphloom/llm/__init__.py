"""Operations of a training-data pipeline: ten operators over documents and pages.

Nothing else in the library imports this subpackage.
"""
