"""Lectern: corpus-scale analytics operators as pure DataFrame functions."""
