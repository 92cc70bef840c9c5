"""Readers: source trees and document tables as files, lines and facts."""
