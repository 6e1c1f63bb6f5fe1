"""Readers: tables, JSON profiles, DOCX and LaTeX manuscripts."""
