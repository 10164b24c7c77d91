"""Training-data operators: ten operators over documents, pages and conversations.

Nothing outside this subpackage imports it.
"""
