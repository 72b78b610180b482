"""Reading file trees and documents, and keeping tables."""
